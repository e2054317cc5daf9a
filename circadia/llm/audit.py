"""What a chain of filters removes, in whatever order they run, told from the ids that fail each.

Every filter leaves one table of failing ids in the shared folder, and so do the two labels that a
filter should lose much or little of. From then on only ids are joined. What a filter removes after
some others is its failing ids without (left-anti) those that fail one of the others; what it finds
removed already is its failing ids that do (left-semi) fail one of them; what survives a set of filters
is all ids without (left-anti) those that fail one; and label losses are failing ids that are (left-semi)
in a label's table. A step of an order depends on the *set* of filters before it alone, so an id
is asked once per set and not once per order, and all sets of all filters are three joins: an id's
sets are laid out beside it after the shuffle, and the condition tells which failing ids belong to the set.

Ids meet by hash, one row per filter at most, so no group is larger than the number of filters times
the sets. Counts are put together before they are shuffled. Copies meet by the checksum of their text in
an aggregate that keeps the smallest id of each task; a copy is then a row that is not in (left-anti) the
table of first holders, joined by text and id together, so a text that a third of the rows share is no hot key.

Defined results: null text is empty text; a null language is the part ''; a row without an id is no copy and
none is a copy of it; labels count an id that has them in any row; repeated rows are documents of their own,
but not copies of each other, as neither id is smaller; a table without documents has no parts and gives no rows.
Other columns are not read.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .storage import held, picked

#: The words of ``text``, in Spark's regular expressions.
_BLANKS = r"[\x20\x09-\x0D]+"


def word_list() -> Column:
    return F.array_remove(F.split("text", _BLANKS), "")


#: Conditions under which a text fails, by filter; ``n_words`` and ``n_distinct`` are of its words.
TEXT_FILTERS = {
    "A": "n_words < 200",
    "B": "100 * n_distinct < 50 * n_words",
    "C": "100 * regexp_count(text, '[A-Z]') > 3 * length(text)",
    "D": "text rlike '[#$%&*|]'",
}
COPIES = "E"


def _documents(docs: DataFrame, filters: Mapping[str, str]) -> DataFrame:
    """key (of the row), doc_id, part, checksum of the text and a flag per filter, from one pass over the texts."""
    rows = picked(docs, doc_id="doc_id", text="text", lang="lang")
    rows = rows.select(
        F.monotonically_increasing_id().alias("key"),
        "doc_id",
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    rows = rows.withColumn("_words", word_list())
    rows = rows.withColumns({"n_words": F.size("_words"), "n_distinct": F.size(F.array_distinct("_words"))})
    flags = [F.expr(condition).alias(f"fails_{name}") for name, condition in filters.items()]
    return rows.select("key", "doc_id", "part", F.sha2("text", 256).alias("checksum"), *flags)


def copies(rows: DataFrame) -> DataFrame:
    """The rows whose text a smaller id has, too."""
    first = rows.where("doc_id is not null").groupBy("checksum").agg(F.min("doc_id").alias("doc_id"))
    # the join is on text and id, which no two texts and few rows share
    return rows.where("doc_id is not null").join(first, ["checksum", "doc_id"], "left_anti")


def failing_ids(docs: DataFrame, filters: Mapping[str, str], copies_as: str | None) -> tuple[DataFrame, dict[str, DataFrame]]:
    """(key, doc_id, part) of all documents, and those of every filter's failing ones as a table of its own."""
    rows = held(_documents(docs, filters), "audit-documents")
    ids = ["key", "doc_id", "part"]
    failing = {name: held(rows.where(f"fails_{name}").select(*ids), f"audit-fails-{name}") for name in filters}
    if copies_as is not None:
        failing[copies_as] = held(copies(rows).select(*ids), f"audit-fails-{copies_as}")
    return rows.select(*ids), failing


def _sets(bits: int, without: Column | None) -> Column:
    """All sets of filters as numbers, or those without one filter's bit."""
    sets = F.sequence(F.lit(0), F.lit((1 << bits) - 1))
    return sets if without is None else F.filter(sets, lambda s: s.bitwiseAND(without) == 0)


def relations(everything: DataFrame, failing: Mapping[str, DataFrame], labelled: Mapping[str, DataFrame]) -> DataFrame:
    """Counts per part: (part, kind, bit, before, n).

    kind 'kept': documents that survive the set of filters ``before``. kinds 'removed' and 'redundant', and
    'lost <label>' for each table of ``labelled``: documents that filter ``bit`` removes after the set ``before``,
    that it would have removed but the set did, and removed ones with the label. Bits are 1, 2, 4, ... in the
    order of ``failing``.
    """
    bits = len(failing)
    tagged = [rows.select("key", "doc_id", "part", F.lit(1 << i).alias("bit")) for i, rows in enumerate(failing.values())]
    fails = reduce(DataFrame.unionByName, tagged)
    # the sets are laid out beside the ids after these have been dealt by key, so they are not shuffled
    others = fails.select("key", F.col("bit").alias("_other")).hint("shuffle_hash")
    met = F.col("before").bitwiseAND(F.col("_other")) != 0

    def asked(rows: DataFrame, without: Column | None) -> DataFrame:
        return rows.repartition("key").withColumn("before", F.explode(_sets(bits, without)))

    def joined(rows: DataFrame, how: str) -> DataFrame:
        near = rows.alias("a").join(others.alias("b"), (F.col("a.key") == F.col("b.key")) & met, how)
        return near.groupBy("part", "kind", "bit", "before").agg(F.count("*").alias("n"))

    with_label = [
        fails.join(rows.select("doc_id").distinct(), "doc_id", "left_semi").select("key", "part", "bit", F.lit(f"lost {name}").alias("kind"))
        for name, rows in labelled.items()
    ]
    removed = reduce(DataFrame.unionByName, [fails.select("key", "part", "bit", F.lit("removed").alias("kind")), *with_label])
    redundant = fails.select("key", "part", "bit", F.lit("redundant").alias("kind"))
    kept = everything.select("key", "part", F.lit(0).alias("bit"), F.lit("kept").alias("kind"))
    own = F.col("bit")
    parts = [
        joined(asked(kept, None), "left_anti"),
        joined(asked(removed, own), "left_anti"),
        joined(asked(redundant, own), "left_semi"),
    ]
    return reduce(DataFrame.unionByName, parts)


def interactions(docs: DataFrame, labels: DataFrame, filters: Mapping[str, str] = TEXT_FILTERS, copies_as: str | None = COPIES) -> DataFrame:
    """One row per part, order of all filters and step; see the columns below.

    part, filter_order, step (from 1; its filter is that letter of the order), and of documents of the part: kept
    (after the step), removed (by it), redundant (it would have removed them, an earlier step did), unique_fails
    (fail this filter only), good_lost and toxic_lost (removed and labelled quality = 1, toxic = 1), shapley
    (removed by the step's filter, summed over all orders).
    """
    everything, failing = failing_ids(docs, filters, copies_as)
    names = list(failing)
    known = picked(labels, doc_id="doc_id", quality="quality", toxic="toxic")
    labelled = {"good": known.where("quality = 1"), "toxic": known.where("toxic = 1")}
    counts = relations(everything, failing, labelled)
    # a part has at most (number of filters + 1) x sets x kinds counts, whatever its documents
    address = lambda kind, bit, before: F.concat_ws(" ", kind, bit.cast("string"), before.cast("string"))
    entry = F.struct(address(F.col("kind"), F.col("bit"), F.col("before")), "n")
    known_parts = counts.groupBy("part").agg(F.map_from_entries(F.collect_list(entry)).alias("_n"))
    parts = everything.select("part").distinct().join(known_parts, "part", "left")

    whole, steps = (1 << len(names)) - 1, []
    for order in permutations(names):
        before = 0
        for step, name in enumerate(order, start=1):
            bit = 1 << names.index(name)
            steps.append({"order": "".join(order), "step": step, "bit": bit, "before": before})
            before |= bit
    # as one literal: the driver would build thousands of expressions otherwise
    fixed = F.from_json(F.lit(json.dumps(steps)), "array<struct<order: string, step: int, bit: int, before: int>>")
    at = parts.withColumn("_step", F.explode(fixed))
    bit, before = F.col("_step.bit"), F.col("_step.before")

    def n(kind: str, of: Column, after: Column) -> Column:
        return F.coalesce(F.element_at("_n", address(F.lit(kind), of, after)), F.lit(0)).cast("long")

    report = at.select(
        "part",
        F.col("_step.order").alias("filter_order"),
        F.col("_step.step").alias("step"),
        n("kept", F.lit(0), before + bit).alias("kept"),
        n("removed", bit, before).alias("removed"),
        n("redundant", bit, before).alias("redundant"),
        n("removed", bit, whole - bit).alias("unique_fails"),
        n("lost good", bit, before).alias("good_lost"),
        n("lost toxic", bit, before).alias("toxic_lost"),
        bit.alias("_bit"),
    )
    # 120 orders a part and filter, five filters: this window never has more rows
    return report.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "_bit"))).drop("_bit")
