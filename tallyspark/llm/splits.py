"""Splits that keep the records of one issuer together.

Sources are linked by registry number and by name. Names are compared without look, case, marks,
legal form, article and slips of two swapped neighbouring letters; different names meet over a
shared registry number, and so over other sources. The start of a source id is no link, since
different issuers share it.

Defined results: a source without name and number is a group of its own; null source ids are left
out; repeated rows count once; no sources give no rows.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.llm.components import components
from tallyspark.llm.textnorm import fold
from tallyspark.operators.ranged import running
from tallyspark.session import cut

# Legal forms at the end of a name.
LEGAL_FORMS = frozenset("ab ag as asa bsc co company corp corporation cpt gmbh inc incorporated kg kscp limited llc llp ltd nv oyj pjsc plc pty qpsc sa sae saog sarl sas se spa".split())

#: Orders of the components that are tried.
SALTS = 8


def name_key(name: str | None) -> str | None:
    """A name without its look, case, marks, article and legal form; None if nothing is left."""
    words = (fold(name, glue=".'\u2019") or "").split()
    if len(words) > 1 and words[0] == "the":
        words = words[1:]
    while len(words) > 1 and words[-1] in LEGAL_FORMS:
        words = words[:-1]
    return " ".join(words) or None


def swaps(key: str) -> list[str]:
    """The key itself and every form of it with two neighbouring letters of a word swapped."""
    out = {key}
    for i in range(len(key) - 1):
        a, b = key[i], key[i + 1]
        if a != b and a != " " and b != " ":
            out.add(f"{key[:i]}{b}{a}{key[i + 2:]}")
    return sorted(out)


@F.pandas_udf(T.StringType())
def _name_key(names: pd.Series) -> pd.Series:
    return names.map(name_key)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _swaps(keys: pd.Series) -> pd.Series:
    return keys.map(swaps)


def number_key(cik: Column) -> Column:
    """The digits of a registry number without leading zeros or a decimal tail; null if there are none."""
    digits = F.regexp_replace(F.regexp_replace(cik, "\\.0*\\s*$", ""), "[^0-9]", "")
    bare = F.regexp_replace(digits, "^0+", "")
    return F.when(bare != "", bare)


def issuer_groups(sources: DataFrame) -> DataFrame:
    """(source_id, component) of every source; the component is a key of the issuer."""
    plain = sources.where("source_id IS NOT NULL").select("source_id", "issuer", number_key(F.col("cik")).alias("c")).distinct()
    keyed = plain.withColumn("n", _name_key("issuer")).select("source_id", F.concat(F.lit("n:"), "n").alias("n"), F.concat(F.lit("c:"), "c").alias("c")).distinct()
    keyed = cut(keyed)
    named = keyed.where("n IS NOT NULL AND c IS NOT NULL").select(F.col("n").alias("u"), F.col("c").alias("v")).distinct()
    names = keyed.where("n IS NOT NULL").select("n").distinct()
    forms = names.select("n", F.explode(_swaps("n")).alias("form"))
    shared = forms.groupBy("form").agg(F.min("n").alias("u"), F.max("n").alias("last")).where("u <> last")
    slips = forms.join(shared.select("form", "u"), "form").where("n <> u").select("u", F.col("n").alias("v"))
    many = keyed.groupBy("source_id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("source_id")
    torn = keyed.join(many, "source_id").select(F.concat(F.lit("s:"), "source_id").alias("u"), F.explode(F.array_compact(F.array("n", "c"))).alias("v"))
    found = components(named.unionByName(slips).unionByName(torn))
    keys = keyed.groupBy("source_id").agg(F.min(F.coalesce("n", "c")).alias("key")).withColumn("key", F.coalesce("key", F.concat(F.lit("s:"), "source_id")))
    return keys.join(found, keys["key"] == found["node"], "left").select("source_id", F.coalesce("component", "key").alias("component"))


def grouped_pairs(groups: DataFrame) -> DataFrame:
    """(first_source_id, source_id): each source of a group but its smallest, with that smallest."""
    first = groups.groupBy("component").agg(F.min("source_id").alias("first_source_id"), F.count(F.lit(1)).alias("size")).where("size > 1")
    return groups.join(first, "component").where("source_id <> first_source_id").select("first_source_id", "source_id")


def assign_pools(groups: DataFrame, weights: DataFrame, targets: DataFrame) -> DataFrame:
    """(source_id, component, pool): each component goes whole into one pool, at the target shares.

    ``weights`` is (source_id, records). Components stand in the order of a salted hash; distributed
    running totals give each its place on the line of records, and the pool whose stretch holds the middle
    of it takes it. A large component that lies across an end makes its pool too large or too small by up
    to half of it, so ``SALTS`` orders are laid side by side and the one that comes closest to the targets
    is taken. Without a target there is no pool.
    """
    own = weights.groupBy("source_id").agg(F.sum("records").alias("records"))
    sized = groups.select("source_id", "component").join(own, "source_id", "left").groupBy("component").agg(F.sum(F.coalesce("records", F.lit(0)) + F.lit(1e-6)).alias("size"))
    whole = sized.agg(F.sum("size").alias("whole"))
    salted = sized.select("component", "size", F.explode(F.array(*map(F.lit, range(SALTS)))).alias("salt")).withColumn("key", F.xxhash64("salt", "component"))
    line = running(salted, ["salt"], ["key", "component"], F.col("size"), "upto")
    middle = (F.col("upto") - F.col("size") / 2) / F.col("whole")
    placed = line.crossJoin(F.broadcast(whole)).crossJoin(F.broadcast(_ends(targets)))  # two single rows
    at = F.filter("ends", lambda e: middle < e["end"])
    pool = F.coalesce(F.get(at, 0)["pool"], F.element_at("ends", -1)["pool"])
    placed = cut(placed.select("salt", "component", "size", "whole", pool.alias("pool")))
    reached = placed.groupBy("salt", "pool").agg((F.sum("size") / F.max("whole")).alias("reached"))
    wanted = _shares(targets)
    off = placed.select("salt").distinct().crossJoin(F.broadcast(wanted)).join(reached, ["salt", "pool"], "left")  # salts x pools
    best = off.groupBy("salt").agg(F.max(F.abs(F.col("wanted") - F.coalesce("reached", F.lit(0.0)))).alias("off")).agg(F.min(F.struct("off", "salt"))["salt"].alias("best"))
    chosen = placed.crossJoin(F.broadcast(best)).where("salt = coalesce(best, 0)").select("component", "pool")
    return groups.select("source_id", "component").join(chosen, "component", "left").select("source_id", "component", "pool")


def _shares(targets: DataFrame) -> DataFrame:
    """(pool, wanted): the shares, brought to a sum of one; a pool without a share or a name is none."""
    each = targets.where("pool IS NOT NULL AND share > 0").groupBy("pool").agg(F.sum(F.col("share").cast("double")).alias("share"))
    total = each.agg(F.sum("share").alias("total"))
    return each.crossJoin(F.broadcast(total)).select("pool", (F.col("share") / F.col("total")).alias("wanted"))


def _ends(targets: DataFrame) -> DataFrame:
    """One row: where the stretch of each pool ends on a line of length one, in the order of the pools."""
    order = Window.orderBy("pool").rowsBetween(Window.unboundedPreceding, 0)  # the pools only
    line = _shares(targets).withColumn("end", F.sum("wanted").over(order))
    return line.agg(F.array_sort(F.collect_list(F.struct("end", "pool"))).alias("ends"))
