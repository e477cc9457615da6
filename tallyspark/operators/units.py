"""Figures in different units and scales, brought to whole single units of their ISO currency.

Declarative throughout: ``regexp_extract`` takes the number, the scale word and the currency word
out of captions and printed figures, small alias tables are joined to them, ``coalesce`` picks the
nearest unit (own column, own caption, printed figure, statement column, statement caption), and
factor and offset are applied in DECIMAL.

Defined results: a figure without any scale counts as single units (the source default); a figure
without any currency gets a null currency; an input with neither ``reported`` nor a readable
``raw_text`` gives no row; an unknown unit word is no unit; an amount that no BIGINT holds is null and not ``exact``, and the other rows
come out all the same. Repeated rows give one result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Scale words by language, with the factor each stands for.
SCALE_WORDS: dict[str, str] = {
    "single units": "1", "single unit": "1", "whole units": "1", "full units": "1", "units": "1", "unit": "1", "whole": "1", "full": "1",
    "thousands": "1000", "thousand": "1000", "'000": "1000", "000s": "1000", "'000s": "1000", "000": "1000", "k": "1000", "th": "1000",
    "millions": "1000000", "million": "1000000", "mns": "1000000", "mn": "1000000", "mln": "1000000", "mm": "1000000", "m": "1000000",
    "billions": "1000000000", "billion": "1000000000", "bns": "1000000000", "bn": "1000000000", "bln": "1000000000", "b": "1000000000",
    "unités entières": "1", "unité": "1", "unités": "1", "milliers": "1000", "millier": "1000", "mille": "1000", "milliards": "1000000000", "milliard": "1000000000", "mds": "1000000000", "md": "1000000000", "mrd": "1000000000",
    "وحدات كاملة": "1", "وحدة كاملة": "1", "وحدات": "1", "وحدة": "1", "آلاف": "1000", "الآلاف": "1000", "ألف": "1000", "الاف": "1000", "الف": "1000",
    "ملايين": "1000000", "الملايين": "1000000", "مليون": "1000000", "مليارات": "1000000000", "المليارات": "1000000000", "مليار": "1000000000", "بلايين": "1000000000", "بليون": "1000000000",
}

# Currency words and codes, with the ISO code each stands for.
CURRENCY_WORDS: dict[str, str] = {
    "sar": "SAR", "sr": "SAR", "saudi riyals": "SAR", "saudi riyal": "SAR", "riyals saoudiens": "SAR", "riyal saoudien": "SAR", "ريالات سعودية": "SAR", "الريالات السعودية": "SAR", "ريال سعودي": "SAR", "الريال السعودي": "SAR", "ر.س": "SAR",
    "aed": "AED", "dhs": "AED", "dh": "AED", "emirati dirhams": "AED", "emirati dirham": "AED", "uae dirhams": "AED", "uae dirham": "AED", "dirhams des émirats": "AED", "dirhams émiratis": "AED", "dirham des émirats": "AED", "الدراهم الإماراتية": "AED", "دراهم إماراتية": "AED", "درهم إماراتي": "AED", "الدرهم الإماراتي": "AED", "د.إ": "AED",
    "egp": "EGP", "le": "EGP", "l.e.": "EGP", "e£": "EGP", "egyptian pounds": "EGP", "egyptian pound": "EGP", "livres égyptiennes": "EGP", "livre égyptienne": "EGP", "الجنيهات المصرية": "EGP", "جنيهات مصرية": "EGP", "جنيه مصري": "EGP", "الجنيه المصري": "EGP", "ج.م": "EGP",
    "kwd": "KWD", "kd": "KWD", "kuwaiti dinars": "KWD", "kuwaiti dinar": "KWD", "dinars koweïtiens": "KWD", "dinar koweïtien": "KWD", "الدنانير الكويتية": "KWD", "دنانير كويتية": "KWD", "دينار كويتي": "KWD", "الدينار الكويتي": "KWD", "د.ك": "KWD",
    "mad": "MAD", "moroccan dirhams": "MAD", "moroccan dirham": "MAD", "dirhams marocains": "MAD", "dirham marocain": "MAD", "الدراهم المغربية": "MAD", "دراهم مغربية": "MAD", "درهم مغربي": "MAD", "الدرهم المغربي": "MAD",
    "usd": "USD", "us$": "USD", "$": "USD", "us dollars": "USD", "us dollar": "USD", "u.s. dollars": "USD", "dollars américains": "USD", "dollar américain": "USD", "الدولارات الأمريكية": "USD", "دولارات أمريكية": "USD", "دولار أمريكي": "USD", "الدولار الأمريكي": "USD",
    "eur": "EUR", "€": "EUR", "euros": "EUR", "euro": "EUR", "اليورو": "EUR", "يورو": "EUR",
}

# Names of subunits; each settles scale and currency at once.
SUBUNIT_WORDS: dict[str, tuple[str, str]] = {
    "halalas": ("0.01", "SAR"), "halala": ("0.01", "SAR"), "هللات": ("0.01", "SAR"), "هللة": ("0.01", "SAR"), "الهللات": ("0.01", "SAR"),
    "egyptian piastres": ("0.01", "EGP"), "piastres égyptiennes": ("0.01", "EGP"), "piastres": ("0.01", "EGP"), "piastre": ("0.01", "EGP"), "قروش": ("0.01", "EGP"), "قرش": ("0.01", "EGP"), "القروش": ("0.01", "EGP"),
    "uae fils": ("0.01", "AED"), "emirati fils": ("0.01", "AED"), "fils des émirats": ("0.01", "AED"), "فلوس إماراتية": ("0.01", "AED"), "فلس إماراتي": ("0.01", "AED"), "الفلوس الإماراتية": ("0.01", "AED"),
    "kuwaiti fils": ("0.001", "KWD"), "fils koweïtiens": ("0.001", "KWD"), "فلوس كويتية": ("0.001", "KWD"), "فلس كويتي": ("0.001", "KWD"), "الفلوس الكويتية": ("0.001", "KWD"),
    "centimes marocains": ("0.01", "MAD"), "moroccan centimes": ("0.01", "MAD"), "santimat": ("0.01", "MAD"), "سنتيمات مغربية": ("0.01", "MAD"), "سنتيم مغربي": ("0.01", "MAD"),
    "us cents": ("0.01", "USD"), "cents américains": ("0.01", "USD"), "سنتات أمريكية": ("0.01", "USD"), "سنت أمريكي": ("0.01", "USD"),
    "euro cents": ("0.01", "EUR"), "centimes d'euro": ("0.01", "EUR"), "eurocents": ("0.01", "EUR"), "سنتات اليورو": ("0.01", "EUR"), "سنت يورو": ("0.01", "EUR"),
}

#: Items that are figures per share: never scaled, so not converted here.
PER_SHARE_ITEMS = ("per_share_basic", "per_share_diluted")

#: Units whose zero lies elsewhere: word -> what is added after the factor. None of the units of money does.
UNIT_OFFSETS: dict[str, str] = {}

_META = set("\\.^$|?*+()[]{}")


def _alternation(words) -> str:  # noqa: ANN001
    return "|".join("".join("\\" + c if c in _META else c for c in w) for w in sorted(words, key=lambda w: (-len(w), w)))


def _extract(text: Column, words) -> Column:  # noqa: ANN001
    """The first (leftmost, then longest) word of a list, standing alone; Arabic words may carry a prefix letter."""
    latin = _alternation(w for w in words if not "؀" <= w[0] <= "ۿ")
    arabic = _alternation(w for w in words if "؀" <= w[0] <= "ۿ")
    pattern = f"(?<![\\p{{L}}\\p{{N}}.,])(?:{latin})(?![\\p{{L}}\\p{{N}}])|(?<![\\p{{L}}])(?:[وبلك]|ال|بال|وال|لل)?(?:{arabic})(?![\\p{{L}}])"
    word = F.regexp_extract(text, f"({pattern})", 1)
    return F.when(word != "", word)


def _clean(text: Column) -> Column:
    """Lower case, straight apostrophes, plain spaces, no invisible characters."""
    out = F.regexp_replace(F.lower(text), "[’‘`´]", "'")
    out = F.regexp_replace(out, "[\\u200b-\\u200f\\u2060\\ufeff\\u00ad\\u061c\\u0640]", "")
    return F.trim(F.regexp_replace(out, "[\\s\\u00a0\\u2000-\\u200a\\u202f\\u205f\\u3000]+", " "))


def unit_tables(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """(scale_alias, factor, offset) and (currency_alias, currency, factor and offset of a subunit): fixed lists of about a hundred rows.

    All units of money begin at zero; a unit that does not (a temperature, an index) has its offset in ``UNIT_OFFSETS``.
    """
    arabic = lambda w: "؀" <= w[0] <= "ۿ"
    prefixes = ("", "و", "ب", "ل", "ك", "ال", "بال", "وال", "لل")
    spread = lambda w: [p + w for p in prefixes] if arabic(w) else [w]
    scales: dict[str, str] = {}
    currencies: dict[str, tuple[str, str | None]] = {}
    for word, factor in SCALE_WORDS.items():
        scales |= dict.fromkeys(spread(word), factor)
    for word, code in CURRENCY_WORDS.items():
        currencies |= dict.fromkeys(spread(word), (code, None))
    for word, (factor, code) in SUBUNIT_WORDS.items():
        currencies |= dict.fromkeys(spread(word), (code, factor))
    offset = lambda word: UNIT_OFFSETS.get(word, "0")
    scale = spark.createDataFrame([(w, f, offset(w)) for w, f in sorted(scales.items())], "scale_alias STRING, factor STRING, shift STRING")
    scale = scale.select("scale_alias", F.col("factor").cast("decimal(13,3)").alias("alias_scale"), F.col("shift").cast("decimal(13,6)").alias("alias_offset"))
    currency = spark.createDataFrame([(w, c, f, offset(w) if f else None) for w, (c, f) in sorted(currencies.items())], "currency_alias STRING, alias_currency STRING, factor STRING, shift STRING")
    currency = currency.select("currency_alias", "alias_currency", F.col("factor").cast("decimal(13,3)").alias("alias_sub"), F.col("shift").cast("decimal(13,6)").alias("sub_offset"))
    return scale, currency


def with_units(df: DataFrame, text: str, out: str, printed: bool = False) -> DataFrame:
    """Add ``<out>_scale``, ``<out>_offset`` and ``<out>_currency``, read from the caption or printed figure in ``text``."""
    scales, currencies = unit_tables(df.sparkSession)
    clean = _clean(F.col(text))
    if printed:  # the figure itself is no unit: "12 000 units"
        outside = F.regexp_replace(clean, "[\\d٠-٩۰-۹][\\d٠-٩۰-۹,.٬٫' ]*", " ")
    else:  # nor is a rate in brackets: "(1,000 fils to the dinar)"
        outside = F.regexp_replace(clean, "\\([^)]*\\d[^)]*\\bto\\b[^)]*\\)", "")
    words = F.coalesce(_extract(outside, SUBUNIT_WORDS), _extract(outside, CURRENCY_WORDS))
    df = df.withColumns({"_s": _extract(outside, SCALE_WORDS), "_c": words})
    df = df.join(F.broadcast(scales), F.col("_s") == F.col("scale_alias"), "left").join(F.broadcast(currencies), F.col("_c") == F.col("currency_alias"), "left")
    df = df.withColumns({f"{out}_scale": F.coalesce("alias_sub", "alias_scale"), f"{out}_offset": F.coalesce("sub_offset", "alias_offset"), f"{out}_currency": F.col("alias_currency")})
    return df.drop("_s", "_c", "scale_alias", "alias_scale", "alias_offset", "currency_alias", "alias_currency", "alias_sub", "sub_offset")


def printed_number(text: Column) -> Column:
    """The signed number of a printed figure as DECIMAL(38,6), null where there is none.

    Arabic-Indic digits, spaces or commas between groups of three, a dot or Arabic decimal mark, and
    a comma that is not followed by groups of three as decimal mark. Parentheses or a minus sign on
    either side make it negative.
    """
    plain = F.translate(text, "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹٬٫−–—﹣－", "01234567890123456789,.-----")
    plain = F.regexp_replace(plain, "[\\u200b-\\u200f\\u061c\\u202a-\\u202e\\u2060-\\u2069\\ufeff]", "")
    number = F.regexp_extract(plain, "(\\d[\\d,.'\\s\\u00a0\\u2000-\\u200a\\u202f\\u205f]*)", 1)
    packed = F.regexp_replace(number, "['\\s\\u00a0\\u2000-\\u200a\\u202f\\u205f]", "")
    packed = F.regexp_replace(packed, "[.,]+$", "")
    dotted = F.when(packed.rlike("^\\d{1,3}(\\.\\d{3}){2,}$"), F.regexp_replace(packed, "\\.", "")).when(packed.rlike("^\\d{1,3}(\\.\\d{3})+,\\d+$"), F.regexp_replace(F.regexp_replace(packed, "\\.", ""), ",", "."))
    value = F.coalesce(dotted, F.when(packed.rlike("^\\d+(,\\d{3})*(\\.\\d+)?$"), F.regexp_replace(packed, ",", "")), F.when(packed.rlike("^\\d+,\\d+$"), F.regexp_replace(packed, ",", ".")))
    negative = plain.rlike("\\([^()]*\\d[^()]*\\)") | plain.rlike("-\\s*[^\\d\\s]{0,4}\\s*\\d") & ~plain.rlike("\\d\\s*-\\s*\\d") | plain.rlike("\\d\\s*-\\s*[^\\d]*$")
    size = value.try_cast("decimal(38,6)")
    return F.when(negative, -size).otherwise(size)


def whole_units(inputs: DataFrame, statements: DataFrame) -> DataFrame:
    """(input_id, amount BIGINT, currency, scale, exact) of every input with a figure.

    ``inputs`` has one row per MetricInput and may repeat; ``statements`` has a unique statement_id.
    The unit is the nearest one given, for scale and currency apart. An input whose own unit is
    complete is sent to no particular statement (its join key is spread), so a statement that holds
    a third of all inputs costs no more than it must; AQE splits what stays skewed.
    """
    want = inputs.where(F.col("canonical_id").isNull() | ~F.col("canonical_id").isin(*PER_SHARE_ITEMS))
    want = want.withColumn("figure", F.coalesce(F.col("reported"), printed_number(F.col("raw_text")))).where("figure IS NOT NULL")
    want = want.select("input_id", "statement_id", "figure", F.col("scale").alias("own_scale"), F.col("currency").alias("own_currency"), F.col("unit_text").alias("own_caption"), "raw_text")
    want = with_units(with_units(want, "own_caption", "caption"), "raw_text", "printed", printed=True)
    want = want.select(
        "input_id", "figure",
        F.coalesce(F.col("own_scale").try_cast("decimal(13,3)"), "caption_scale", "printed_scale").alias("near_scale"),
        F.when(F.col("own_scale").isNull(), F.coalesce("caption_offset", "printed_offset")).alias("near_offset"),
        F.coalesce(_iso(F.col("own_currency")), "caption_currency", "printed_currency").alias("near_currency"),
        "statement_id",
    )
    complete = F.col("near_scale").isNotNull() & F.col("near_currency").isNotNull()
    want = want.withColumn("unit_of", F.when(complete | F.col("statement_id").isNull(), F.concat(F.lit("\u0000"), F.col("input_id").cast("string"))).otherwise(F.col("statement_id"))).drop("statement_id")
    given = with_units(statements.select(F.col("statement_id").alias("unit_of"), F.col("scale").alias("given_scale"), F.col("currency").alias("given_currency"), F.col("unit_text").alias("given_caption")), "given_caption", "st")
    given = given.select("unit_of", F.coalesce(F.col("given_scale").try_cast("decimal(13,3)"), "st_scale").alias("st_scale"), F.when(F.col("given_scale").isNull(), F.col("st_offset")).alias("st_offset"), F.coalesce(_iso(F.col("given_currency")), "st_currency").alias("st_currency"))
    joined = want.join(given, "unit_of", "left")
    scale = F.coalesce("near_scale", "st_scale", F.lit(1).cast("decimal(13,3)"))
    offset = F.coalesce(F.when(F.col("near_scale").isNotNull(), F.col("near_offset")).otherwise(F.col("st_offset")), F.lit(0).cast("decimal(13,6)"))
    scaled = F.try_add(F.try_multiply(F.col("figure"), scale), offset).try_cast("decimal(38,6)")
    amount = F.round(scaled, 0).try_cast("bigint")
    exact = F.coalesce(amount.isNotNull() & (F.round(scaled, 0) == scaled), F.lit(False))
    out = joined.select("input_id", amount.alias("amount"), F.coalesce("near_currency", "st_currency").alias("currency"), scale.alias("scale"), exact.alias("exact"))
    return out.dropDuplicates(["input_id"])


def _iso(code: Column) -> Column:
    """A currency column as its ISO code; other text in it counts as absent."""
    up = F.upper(F.trim(code))
    return F.when(up.rlike("^[A-Z]{3}$"), up)


def metric_inputs(metric_values: DataFrame) -> DataFrame:
    """One row per MetricInput with its owner, role and position; nothing is shuffled."""
    roles = metric_values.select("metric_value_id", F.explode("inputs").alias("role", "used"))
    items = roles.select("metric_value_id", "role", F.posexplode("used").alias("position", "item"))
    return items.where("item IS NOT NULL").select("metric_value_id", "role", "position", "item.*")
