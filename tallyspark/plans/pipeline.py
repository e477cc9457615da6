"""Queries of the data-pipeline operators of the core: units (3) and nested records (4)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyspark.operators import shred, units
from tallyspark.session import table

Query = Callable[[SparkSession, str], DataFrame]


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """(input_id, amount, currency): each figure in whole single units of its currency."""
    out = units.whole_units(units.metric_inputs(table(spark, folder, "metric_values")), table(spark, folder, "statements"))
    return out.where("amount IS NOT NULL AND currency IS NOT NULL").select("input_id", "amount", "currency")


def p3_units(spark: SparkSession, folder: str) -> DataFrame:
    """(input_id, amount, currency, scale, exact): also what has no currency or is no whole number."""
    out = units.whole_units(units.metric_inputs(table(spark, folder, "metric_values")), table(spark, folder, "statements"))
    return out.withColumn("scale", out["scale"].cast("double"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """(record_id, branch, position, leaf): every row value and every input, under its parents."""
    return shred.found_leaves(table(spark, folder, "gold_files"), table(spark, folder, "metric_values"))


def _gold(view: Callable[[DataFrame], DataFrame], *keep: str) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        return view(shred.shred_files(table(spark, folder, "gold_files"), keep))

    return query


def p4_rejects(spark: SparkSession, folder: str) -> DataFrame:
    """Deliveries that hold no whole file."""
    return shred.rejects(table(spark, folder, "gold_files"))


def p4_inputs(spark: SparkSession, folder: str) -> DataFrame:
    """Flat table of the MetricInputs."""
    return shred.inputs(shred.shred_inputs(table(spark, folder, "metric_values")))


QUERIES: dict[str, Query] = {
    "p3_found": p3_found, "p3_units": p3_units,
    "p4_found": p4_found, "p4_files": _gold(shred.files, "sha256", "status", "note", "extra"), "p4_statements": _gold(shred.statements, *[f"statements.item.{k}" for k in ("type", "page_mode", "scale", "currency", "extra")]), "p4_periods": _gold(lambda s: shred.periods(s).drop("extra"), "statements.item.periods"),
    "p4_periods_full": _gold(shred.periods, "statements.item.periods"), "p4_checked_by": _gold(shred.checked_by, "checked_by"),
    "p4_rows": _gold(shred.rows, *[f"statements.item.rows.item.{k}" for k in ("label", "canonical_id", "extra")]), "p4_values": _gold(shred.values, "statements.item.rows.item.values"), "p4_unconfirmed": _gold(shred.unconfirmed, "statements.item.rows.item.unconfirmed"), "p4_pages": _gold(shred.pages, "statements.item.pages"),
    "p4_inputs": p4_inputs, "p4_rejects": p4_rejects,
}

# --- the same in SQL -------------------------------------------------------------------------------

_P4 = """WITH d AS (SELECT delivery_id, received_at, body FROM gold_files WHERE json_valid(body)),
u AS (SELECT delivery_id, received_at, CASE WHEN json_type(body) = 'VARCHAR' THEN json_extract_string(body, '$') ELSE body END AS b FROM d),
f AS (SELECT delivery_id, received_at, unnest(CASE WHEN json_type(b, '$.readings') = 'ARRAY' THEN CAST(json_extract(b, '$.readings') AS JSON[]) ELSE [CAST(b AS JSON)] END) AS f FROM u),
l AS (SELECT json_extract_string(f, '$.id') AS file_id, arg_max(f, struct_pack(a := received_at, b := delivery_id)) AS f FROM f WHERE json_extract_string(f, '$.id') IS NOT NULL GROUP BY 1),
s0 AS (SELECT file_id, CASE WHEN json_type(f, '$.statements') = 'ARRAY' THEN CAST(json_extract(f, '$.statements') AS JSON[]) WHEN json_type(f, '$.statements') = 'OBJECT' THEN [json_extract(f, '$.statements')] ELSE CAST([] AS JSON[]) END AS a FROM l),
s AS (SELECT file_id, unnest(range(len(a))) AS sp, unnest(a) AS s FROM s0),
r0 AS (SELECT file_id, sp, CASE WHEN json_type(s, '$.rows') = 'ARRAY' THEN CAST(json_extract(s, '$.rows') AS JSON[]) ELSE CAST([] AS JSON[]) END AS a FROM s),
r AS (SELECT file_id, sp, unnest(range(len(a))) AS rp, unnest(a) AS r FROM r0),
vo AS (SELECT file_id, sp, rp, unnest(json_keys(r, '$.values')) AS k, r FROM r WHERE json_type(r, '$.values') = 'OBJECT'),
va AS (SELECT file_id, sp, rp, unnest(CAST(json_extract(r, '$.values') AS JSON[])) AS p FROM r WHERE json_type(r, '$.values') = 'ARRAY'),
v AS (SELECT file_id, sp, rp, k, json_extract_string(json_extract(r, '$.values'), '$."' || k || '"') AS x FROM vo UNION ALL SELECT file_id, sp, rp, json_extract_string(p, '$.period'), json_extract_string(p, '$.value') FROM va),
m AS (SELECT DISTINCT ON (metric_value_id) metric_value_id, inputs FROM metric_values WHERE inputs IS NOT NULL ORDER BY metric_value_id),
mr AS (SELECT metric_value_id, unnest(map_keys(inputs)) AS role, unnest(map_values(inputs)) AS u FROM m),
mi AS (SELECT metric_value_id, role, unnest(range(len(u))) AS pos, unnest(u) AS i FROM mr WHERE len(u) > 0)"""


def _arabic(word: str) -> bool:
    return "؀" <= word[0] <= "ۿ"


def _sql_list(words: list[str]) -> str:
    """Words as an alternation of a DuckDB pattern, for a SQL literal."""
    quoted = ("".join("\\" + c if c in ".+*?^$|()[]{}\\" else c for c in w) for w in sorted(words, key=lambda w: (-len(w), w)))
    return "|".join(quoted).replace("'", "''")


def _sql_unit(text: str, printed: bool) -> tuple[str, str]:
    """(scale, currency) of a caption or printed figure, as CASE chains over lists of words."""
    clean = f"lower(replace(replace(replace({text}, chr(160), ' '), chr(8239), ' '), '’', ''''))"
    if printed:
        clean = f"regexp_replace({clean}, '[0-9٠-٩][0-9٠-٩,.٬٫ ]*', ' ', 'g')"
    else:
        clean = f"regexp_replace({clean}, '\\([^)]*[0-9][^)]*to[^)]*\\)', '', 'g')"

    def has(words: list[str]) -> str:
        latin, arabic = [w for w in words if not _arabic(w)], [w for w in words if _arabic(w)]
        ways = []
        if latin:
            ways.append(f"(^|[^\\p{{L}}\\p{{N}}.,])({_sql_list(latin)})($|[^\\p{{L}}\\p{{N}}])")
        if arabic:
            ways.append(f"(^|[^\\p{{L}}])([وبلك]|ال|بال|وال|لل)?({_sql_list(arabic)})($|[^\\p{{L}}])")
        return f"regexp_matches({clean}, '{'|'.join(ways)}')"

    subs: dict[tuple[str, str], list[str]] = {}
    for w, unit in units.SUBUNIT_WORDS.items():
        subs.setdefault(unit, []).append(w)
    scales: dict[str, list[str]] = {}
    for w, factor in units.SCALE_WORDS.items():
        scales.setdefault(factor, []).append(w)
    codes: dict[str, list[str]] = {}
    for w, code in units.CURRENCY_WORDS.items():
        codes.setdefault(code, []).append(w)
    sub_scale = " ".join(f"WHEN {has(ws)} THEN {factor}" for (factor, _), ws in subs.items())
    sub_code = " ".join(f"WHEN {has(ws)} THEN '{code}'" for (_, code), ws in subs.items())
    scale = " ".join(f"WHEN {has(scales[f])} THEN {f}" for f in ("1000000000", "1000000", "1000", "1"))  # a caption has one
    code = " ".join(f"WHEN {has(codes[c])} THEN '{c}'" for c in ("AED", "MAD", "SAR", "EGP", "KWD", "EUR", "USD"))
    return f"CASE {sub_scale} {scale} END", f"CASE {sub_code} {code} END"


_CAPTION, _PRINTED, _GIVEN = _sql_unit("unit_text", False), _sql_unit("raw_text", True), _sql_unit("s.unit_text", False)
_FIGURE = r"""COALESCE(reported, CASE WHEN raw_text IS NOT NULL THEN TRY_CAST(replace(regexp_replace(regexp_extract(t, '([0-9][0-9,.\s]*)', 1), '\s', '', 'g'), ',', '') AS DECIMAL(38,6)) * (CASE WHEN regexp_matches(t, '\([^()]*[0-9][^()]*\)|-\s*[^0-9\s]{0,4}\s*[0-9]|[0-9]\s*-\s*[^0-9]*$') THEN -1 ELSE 1 END) END)"""
_P3 = f"""WITH i AS (SELECT DISTINCT ON (input_id) * FROM (SELECT unnest(u, recursive := true) FROM (SELECT unnest(map_values(inputs)) AS u FROM (SELECT inputs FROM metric_values WHERE inputs IS NOT NULL)) WHERE len(u) > 0)),
j AS (SELECT *, replace(replace(translate(raw_text, '٠١٢٣٤٥٦٧٨٩٬٫−', '0123456789,.-'), chr(160), ' '), chr(8239), ' ') AS t FROM i WHERE canonical_id IS NULL OR canonical_id NOT IN ('per_share_basic', 'per_share_diluted')),
k AS (SELECT input_id, statement_id, {_FIGURE} AS figure, COALESCE(CAST(scale AS DECIMAL(13,3)), {_CAPTION[0]}, {_PRINTED[0]}) AS sc, COALESCE(currency, {_CAPTION[1]}, {_PRINTED[1]}) AS cu FROM j),
st AS (SELECT statement_id, COALESCE(CAST(scale AS DECIMAL(13,3)), {_GIVEN[0]}) AS gs, COALESCE(currency, {_GIVEN[1]}) AS gc FROM statements s)
SELECT input_id, CAST(round(CAST(figure AS DECIMAL(24,6)) * COALESCE(sc, gs, 1), 0) AS BIGINT) AS amount, COALESCE(cu, gc) AS currency FROM k LEFT JOIN st USING (statement_id) WHERE figure IS NOT NULL AND COALESCE(cu, gc) IS NOT NULL"""

ORACLES: dict[str, str] = {
    "p3_found": _P3,
    "p3_units": _P3.split("SELECT input_id, CAST(round(")[0] + "SELECT input_id, CASE WHEN abs(round(x, 0)) < 9223372036854775807 THEN CAST(round(x, 0) AS BIGINT) END AS amount, currency, CAST(f AS DOUBLE) AS scale, round(x, 0) = x AND abs(x) < 9223372036854775807 AS exact FROM (SELECT input_id, CAST(figure AS DECIMAL(24,6)) * COALESCE(sc, gs, 1) AS x, COALESCE(cu, gc) AS currency, COALESCE(sc, gs, 1) AS f FROM k LEFT JOIN st USING (statement_id) WHERE figure IS NOT NULL)",
    "p4_found": _P4 + " SELECT DISTINCT file_id AS record_id, CAST(sp AS VARCHAR) AS branch, rp AS position, k AS leaf FROM v WHERE x IS NOT NULL AND x <> '' UNION ALL SELECT metric_value_id, role, pos, CAST(i.input_id AS VARCHAR) FROM mi",
    "p4_files": _P4 + " SELECT file_id, json_extract_string(f, '$.sha256') AS sha256, json_extract_string(f, '$.status') AS status, json_extract_string(f, '$.note') AS note, CAST(NULL AS VARCHAR) AS extra FROM l",
    "p4_statements": _P4 + " SELECT file_id, sp AS statement_pos, json_extract_string(s, '$.type') AS type, json_extract_string(s, '$.page_mode') AS page_mode, CAST(json_extract_string(s, '$.scale') AS BIGINT) AS scale, json_extract_string(s, '$.currency') AS currency, CAST(NULL AS VARCHAR) AS extra FROM s",
    "p4_rows": _P4 + " SELECT file_id, sp AS statement_pos, rp AS row_pos, json_extract_string(r, '$.label') AS label, json_extract_string(r, '$.canonical_id') AS canonical_id, CAST(NULL AS VARCHAR) AS extra FROM r",
    "p4_values": _P4 + ", o AS (SELECT file_id, sp, rp, unnest(range(len(json_keys(r, '$.values')))) AS p, unnest(json_keys(r, '$.values')) AS k, r FROM r WHERE json_type(r, '$.values') = 'OBJECT'), a AS (SELECT file_id, sp, rp, unnest(range(len(CAST(json_extract(r, '$.values') AS JSON[])))) AS p, unnest(CAST(json_extract(r, '$.values') AS JSON[])) AS e FROM r WHERE json_type(r, '$.values') = 'ARRAY') SELECT file_id, sp AS statement_pos, rp AS row_pos, p AS value_pos, k AS period_key, json_extract_string(json_extract(r, '$.values'), '$.\"' || k || '\"') AS value FROM o UNION ALL SELECT file_id, sp, rp, p, json_extract_string(e, '$.period'), json_extract_string(e, '$.value') FROM a",
    "p4_periods": _P4 + ", pe AS (SELECT file_id, sp, unnest(range(len(CAST(json_extract(s, '$.periods') AS JSON[])))) AS p, unnest(CAST(json_extract(s, '$.periods') AS JSON[])) AS e FROM s WHERE json_type(s, '$.periods') = 'ARRAY') SELECT file_id, sp AS statement_pos, p AS period_pos, json_extract_string(e, '$.key') AS period_key, CAST(json_extract_string(e, '$.end_date') AS DATE) AS end_date, json_extract_string(e, '$.kind') AS kind, CAST(json_extract_string(e, '$.months') AS INTEGER) AS months, CAST(json_extract_string(e, '$.restated') AS BOOLEAN) AS restated, CAST(json_extract_string(e, '$.audited') AS BOOLEAN) AS audited FROM pe",
    "p4_unconfirmed": _P4 + " SELECT file_id, sp AS statement_pos, rp AS row_pos, p AS unconfirmed_pos, json_extract_string(e, '$') AS period_key FROM (SELECT file_id, sp, rp, unnest(range(len(CAST(json_extract(r, '$.unconfirmed') AS JSON[])))) AS p, unnest(CAST(json_extract(r, '$.unconfirmed') AS JSON[])) AS e FROM r WHERE json_type(r, '$.unconfirmed') = 'ARRAY')",
    "p4_pages": _P4 + " SELECT file_id, sp AS statement_pos, p AS page_pos, CAST(json_extract_string(e, '$') AS INTEGER) AS page FROM (SELECT file_id, sp, unnest(range(len(CAST(json_extract(s, '$.pages') AS JSON[])))) AS p, unnest(CAST(json_extract(s, '$.pages') AS JSON[])) AS e FROM s WHERE json_type(s, '$.pages') = 'ARRAY')",
    "p4_checked_by": _P4 + " SELECT file_id, p AS checked_by_pos, json_extract_string(e, '$') AS checked_by FROM (SELECT file_id, unnest(range(len(CAST(json_extract(f, '$.checked_by') AS JSON[])))) AS p, unnest(CAST(json_extract(f, '$.checked_by') AS JSON[])) AS e FROM l WHERE json_type(f, '$.checked_by') = 'ARRAY')",
    "p4_inputs": _P4 + " SELECT metric_value_id, role, pos AS position, i.* FROM mi",
    "p4_rejects": "SELECT delivery_id, received_at, CAST(length(body) AS BIGINT) AS n_chars FROM gold_files WHERE NOT json_valid(body)",
}
ORACLES["p4_periods_full"] = f"SELECT *, CAST(NULL AS VARCHAR) AS extra FROM ({ORACLES['p4_periods']})"
