"""N-gram Jaccard join with adaptive multi-match prefixes.

A document is the set of its distinct k-word shingles (64-bit hashes, see textkernel). Two documents link when
den * |intersection| >= num * |union|. Tokens are ordered by their hash. Of a document with s tokens and a least overlap
t = ceil(num * s / den) with any partner, the first s - t + l tokens share at least l tokens with those of every partner.

* Copies: documents with the same set are one class; only classes are joined.
* Adaptive prefix: a token held by more than `heavy` documents is costly. Of a ladder of l each class takes the step with the
  least estimated number of candidates per match that it must show, among those steps whose longer prefix guarantees a match on
  tokens that aren't costly; it then leaves costly tokens out. A class that shares fewer tokens with all others together than
  any step asks for has no partner. Where no step does (a large group of near copies, a text made of a
  common line) the class is wide.
* Wide classes are matched on all their tokens, ordered by how many of them hold each. Every class with shared tokens first meets
  its hub (of its tokens' most famous classes the one of most tokens).
* Dense groups: wide classes of one hub, more than GROUP of them, are compared by what sets them apart from the group's centre
  (the tokens that more than half of them hold), see _group_links. What near copies have in common is in no list there, so no
  list of pairs grows with the square of the group, and classes near the centre are linked without a pair being formed.
* Of all other classes the hubs are verified, and then all candidates whose components still differ, so no link between
  components is lost; pairs inside a component need no check.

A token's list that is long is dealt to several tasks when it is joined with what is known of the token. Tables on the shared
folder are deleted as soon as their last reader is done.

Verification is exact on the sets. Nothing is capped. Defined results: null text counts as empty; a text without words has no
shingles, links with nothing and is its own component; fewer than k words: the whole sequence is one shingle; repeated rows are
each returned, with their class; a null doc_id is returned and never names a component unless the component has no other id
(then component_id is null); an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .components import components
from .store import dropped, written
from .textkernel import mixed, shingle_sets

#: Parts of a class's tokens by which the ladder's steps lengthen the prefix.
LADDER = (0.0, 0.01, 0.02, 0.03)
#: A token held by more documents than this is costly.
HEAVY = 32
#: Below this many rows the wanted ids are broadcast (16 bytes each), above it they are joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Wide classes of one hub are compared by their differences if they are more than this.
GROUP = 32
#: Steps of a group's table of what is in reach.
STEPS = 64
#: Rows of one key that a task takes at once where a long list meets its key's one row.
DEALT = 1000


def _least_overlap(s: int, num: int, den: int) -> int:
    return (num * s + den - 1) // den


def _step(s: int, part: float, num: int, den: int) -> int:
    return min(1 + int(part * s), _least_overlap(s, num, den))


def class_of(tokens: np.ndarray) -> int:
    """The class id of a set: a 64-bit hash of its sorted tokens."""
    if not len(tokens):
        return 0
    up = np.arange(1, 2 * len(tokens), 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    total = np.add.reduce(mixed(tokens ^ mixed(up))) + np.uint64(len(tokens))
    return int(mixed(np.array([total], dtype=np.uint64)).view(np.int64)[0])


def dealt(left: DataFrame, right: DataFrame, on: list[str], many: str, by: str) -> DataFrame:
    """left joined with right, which has one row for each key `on`. Both have the column `many`, equal for equal keys and in
    proportion to the rows that left has of a key; a key with a large one is dealt to several tasks, by the column `by` of left."""
    parts = F.ceil(F.col(many) / DEALT)
    salted = left.withColumn("_salt", F.pmod(F.xxhash64(by), F.greatest(parts, F.lit(1))))
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(parts, F.lit(1)) - 1))).drop(many)
    return salted.join(copies, [*on, "_salt"]).drop("_salt")


def class_rows(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(doc_id, cid, n, prefix) of every row; prefix: the first tokens in hash order, as many as the ladder's last step asks for."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes, cuts, kept = [], [], [0], []
            for tokens in shingle_sets(batch.column(1), k):
                s = len(tokens)
                ids.append(class_of(tokens))
                sizes.append(s)
                part = tokens[: s - _least_overlap(s, num, den) + _step(s, LADDER[-1], num, den)]
                kept.append(part)
                cuts.append(cuts[-1] + len(part))
            flat = np.concatenate(kept).view(np.int64) if kept else np.zeros(0, np.int64)
            prefix = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(flat, pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), prefix], ["doc_id", "cid", "n", "prefix"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(rows, "doc_id long, cid long, n long, prefix array<long>")


def _keys(classes: DataFrame, num: int, den: int, heavy: int) -> DataFrame:
    """(t, cid, n, need, c, wide): the tokens by which each class is found, and how many must match.

    At each step of the ladder a class with a partner shares with it at least `least` tokens of its prefix, the step's l for the
    smallest size that a partner can have. So a class that shares fewer with anyone at any step has no partner and is left out.
    Of two classes, the one with the lower step finds the other: the other's prefix holds at least that step's tokens.
    """
    spread = classes.select("cid", "n", F.posexplode("prefix").alias("pos", "t"))
    shared = spread.groupBy("t").agg(F.count("*").alias("c")).where("c > 1")
    found = written(spread.join(shared, "t"))
    overlap = F.floor((F.col("n") * num + den - 1) / den)
    costly = F.col("c") > heavy

    def step(part: float, size: F.Column) -> F.Column:
        return F.least(F.floor(size * F.lit(part)) + 1, F.floor((size * num + den - 1) / den))

    sums, alive = [], F.lit(True)
    for i, part in enumerate(LADDER):
        inside = F.col("pos") < F.col("n") - overlap + step(part, F.col("n"))
        sums += [F.count_if(inside & costly).alias(f"heavy{i}"), F.count_if(inside & ~costly).alias(f"light{i}"), F.sum(F.when(inside & ~costly, F.col("c") - 1).otherwise(0)).alias(f"cost{i}")]
        alive &= F.col(f"heavy{i}") + F.col(f"light{i}") >= step(part, overlap)
    by_class = found.groupBy("cid", "n").agg(*sums).where(alive)
    options = []
    for i, part in enumerate(LADDER):
        show = step(part, overlap) - F.col(f"heavy{i}")
        options.append(F.when(show >= 1, F.struct((F.col(f"cost{i}") / show).alias("cost"), F.lit(i).alias("i"), show.cast("long").alias("need"), (F.col("n") - overlap + step(part, F.col("n"))).cast("long").alias("length"))))
    best = F.array_min(F.filter(F.array(*options), lambda x: x.isNotNull()))
    chosen = by_class.select("cid", best.alias("best"), step(LADDER[-1], overlap).cast("long").alias("all"))
    chosen = chosen.select("cid", F.coalesce("best.need", "all").alias("need"), F.col("best.length").alias("length"))
    keys = found.join(chosen, "cid").where(F.col("length").isNull() | ((F.col("pos") < F.col("length")) & ~costly))
    out = written(keys.select("t", "cid", "n", "need", "c", F.col("length").isNull().alias("wide")))
    dropped(found)
    return out


def _wide_tokens(wanted: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """(cid, n, t, c, rank, lone) of the wide classes `wanted`: all their tokens, ordered by the number c of wide classes that
    hold them (then by hash), and how many only they hold (these come first and are left out)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cid, tokens in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1), k), strict=True):
                many = len(tokens)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(many, cid), pa.int64()), pa.array(np.full(many, many), pa.int64()), pa.array(tokens.view(np.int64))], ["cid", "n", "t"])

    wide = texts.join(wanted, "cid", "left_semi").select("cid", "text")
    tokens = written(wide.mapInArrow(rows, "cid long, n long, t long"))
    counted = tokens.join(tokens.groupBy("t").agg(F.count("*").alias("c")), "t")
    own = Window.partitionBy("cid")
    ranked = counted.withColumn("rank", F.row_number().over(own.orderBy("c", "t")) - 1).withColumn("lone", F.count_if(F.col("c") == 1).over(own))
    out = written(ranked.where("c > 1").select("cid", "n", "t", "c", "rank", "lone"))
    dropped(tokens)
    return out


def _texts(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(cid, text) of the classes wanted(cid, least): one of their texts."""
    names = wanted.select(F.col("least").alias("doc_id")).distinct()
    if wanted.count() <= BROADCAST_ROWS:
        names = F.broadcast(names)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [class_of(tokens) for tokens in shingle_sets(batch.column(0), k)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), batch.column(0)], ["cid", "text"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    held = source.alias("d").join(names.alias("w"), F.col("d.doc_id").eqNullSafe(F.col("w.doc_id")), "left_semi").select("text").mapInArrow(rows, "cid long, text string")
    # a doc_id may stand for several texts, and several rows for one class
    return written(held.join(wanted.select("cid"), "cid", "left_semi").dropDuplicates(["cid"]))


def _groups(wide: DataFrame, hubs: DataFrame) -> DataFrame:
    """(cid, g, members): the wide classes of each hub that has more than GROUP of them, by hubs(cid, hub). A hub is in its own group."""
    chosen = hubs.join(wide.select("cid").distinct(), "cid", "left_semi")
    heads = chosen.groupBy("hub").agg((F.count("*") + 1).alias("members")).where(F.col("members") > GROUP)
    heads = written(heads)
    rest = chosen.join(heads, "hub").join(heads.select(F.col("hub").alias("cid")), "cid", "left_anti").select("cid", F.col("hub").alias("g"), "members")
    out = written(rest.unionByName(heads.select(F.col("hub").alias("cid"), F.col("hub").alias("g"), "members")))
    dropped(heads)
    return out


def _apart(wide: DataFrame, groups: DataFrame, num: int, den: int) -> DataFrame:
    """(g, members, cid, n, w, d, lone, diff) of the classes of each group that have half of their tokens and half of the centre's in common
    with the centre, a set of tokens.

    diff: the tokens that are in one of class and centre only, but for the `lone` ones that no other wide class has; d: the size
    of the difference, lone ones too. Of two classes with differences of d and e tokens, s of them in both, the sets of n and m
    tokens have (n + m - d - e + 2 * s) / 2 in common. So with w = d * (num + den) - n * (den - num) they link if and only if
    2 * (num + den) * s >= w + w'.
    """
    held = wide.join(groups, "cid").select("g", "members", "cid", "n", "t", "c", "lone")
    counts = held.groupBy("g", "t").agg(F.count("*").alias("many"), F.max("members").alias("members"), F.max("c").alias("c"))
    centre = written(counts.where("2 * many > members").select("g", "t", "members", "c"))
    common = written(centre.groupBy("g").agg(F.max("members").alias("members"), F.collect_list("t").alias("centre")))
    inner = dealt(held, centre.drop("members"), ["g", "t"], "c", "cid").groupBy("cid").agg(F.collect_list("t").alias("inner"))
    # a class's tokens are as many as its text has shingles
    tokens = held.groupBy("cid").agg(F.first("g").alias("g"), F.first("members").alias("members"), F.first("n").alias("n"), F.first("lone").alias("lone"), F.collect_list("t").alias("tokens"))
    near = dealt(tokens.join(inner, "cid"), common, ["g"], "members", "cid")
    near = near.where("2 * size(inner) >= size(centre) and 2 * size(inner) >= n")
    near = near.withColumn("diff", F.expr("concat(array_except(tokens, inner), array_except(centre, inner))")).withColumn("d", F.size("diff") + F.col("lone"))
    near = near.withColumn("w", F.col("d") * (num + den) - F.col("n") * (den - num))
    out = written(near.select("g", "members", "cid", "n", "w", "d", "lone", "diff"))
    dropped(centre, common)
    return out


def _group_links(apart: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b): links that join all classes of each group that links reach inside it.

    By the rule of _apart, w + w' <= 0 makes two classes link whatever their differences. So all classes that link in this way with
    the class of the least w, the middle, are one component. Any other class ("outer") must share tokens of its difference with
    a partner's. As s is at most d - lone, a partner's w is at most reach = 2 * (num + den) * (d - lone) - w, and the other way round. So
    a class needs at least ceil((w + w') / (2 * (num + den))) of them, w' the least w of those whose reach is its w or more (by STEPS steps of reach).
    Both hold one of the rarest of their differences' tokens but for those many, less one. These prefixes are joined, and what they find is verified.
    """
    unit = 2 * (num + den)
    apart = apart.withColumn("reach", unit * (F.col("d") - F.col("lone")) - F.col("w"))
    least = apart.groupBy("g").agg(F.min(F.struct("w", "cid")).alias("low"), F.max("members").alias("members"), F.min("reach").alias("lo"), F.max("reach").alias("hi"))
    least = least.select("g", "members", "lo", F.col("low.w").alias("w_low"), F.col("low.cid").alias("middle"), F.expr(f"greatest({unit}L, (hi - lo) div {STEPS} + 1)").alias("step"))
    seen = dealt(apart, least, ["g"], "members", "cid").withColumn("outer", F.expr("w + w_low > 0"))
    seen = written(seen)
    easy = seen.where("not outer and cid <> middle").select(F.col("cid").alias("a"), F.col("middle").alias("b"))
    steps = seen.groupBy("g", F.expr("(reach - lo) div step").alias("q")).agg(F.min("w").alias("w_all"), F.min(F.when(F.col("outer"), F.col("w"))).alias("w_outer"), F.max("members").alias("members"))
    steps = steps.groupBy("g").agg(F.collect_list(F.struct("q", "w_all", "w_outer")).alias("steps"), F.max("members").alias("members"))
    # an outer class may meet any class, any other one only outer ones; no class in reach: null
    low = "array_min(transform(filter(steps, x -> x.q >= floor((w - lo) / step)), x -> if(outer, x.w_all, x.w_outer)))"
    both = dealt(seen, steps, ["g"], "members", "cid").withColumn("w_other", F.expr(low)).where("w_other <= reach")
    both = both.withColumn("need", F.expr(f"greatest(1, cast(ceil((w + w_other) / {unit}D) as long))")).where("need <= d - lone")
    spread = both.select("g", "cid", "w", "reach", "outer", "d", "need", F.explode("diff").alias("t"))
    counts = spread.groupBy("g", "t").agg(F.count("*").alias("c"), F.count_if("outer").alias("outers")).where("c > 1 and outers > 0")
    ranked = spread.join(counts, ["g", "t"])
    own = Window.partitionBy("cid").orderBy("c", "t")
    # a class's tokens that are in no list come first; they are those of d that are not held here
    held = F.count("*").over(Window.partitionBy("cid"))
    ranked = ranked.withColumn("rank", F.row_number().over(own) - 1 + F.col("d") - held).where("rank <= d - need").select("g", "t", "cid", "w", "reach", "outer")
    ranked = written(ranked)
    other = ranked.select("g", "t", *[F.col(c).alias(f"{c}_2") for c in ("cid", "w", "reach", "outer")]).where("outer_2")
    pairs = ranked.join(other, ["g", "t"]).where("cid <> cid_2 and (not outer or cid < cid_2) and w <= reach_2 and w_2 <= reach").select(F.col("cid").alias("a"), F.col("cid_2").alias("b")).distinct()
    left = seen.select(F.col("cid").alias("a"), F.col("w").alias("w"), F.col("diff").alias("diff"))
    right = seen.select(F.col("cid").alias("b"), F.col("w").alias("w_2"), F.col("diff").alias("diff_2"))
    checked = pairs.join(left, "a").join(right, "b").where(f"{unit} * size(array_intersect(diff, diff_2)) >= w + w_2").select("a", "b")
    out = written(easy.unionByName(checked))
    dropped(seen, ranked)
    return out


def _wide_pairs(wide: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b): candidates among wide classes of different components and dense groups g, by prefixes in the order of rarity.

    Of a pair the smaller class shares 2 * num / (num + den) of its tokens at least, the larger one num / den; so the smaller's
    short prefix meets the larger's long one. Tokens that only one wide class has fill its prefix first, and then those of few,
    so classes with many edits of their own meet only those that share the edits.
    """
    short = F.expr(f"n - floor(({2 * num} * n + {num + den - 1}) / {num + den})")
    long_ = F.expr(f"n - floor(({num} * n + {den - 1}) / {den})")
    near = wide.where(F.col("rank") <= long_).withColumn("short", F.col("rank") <= short)
    # what pairs inside need no check: a dense group, else a component
    near = near.withColumn("set", F.struct(F.col("g").isNull().alias("x"), F.coalesce("g", "comp").alias("y")))
    sizes = near.groupBy("t", "set").agg(F.count("*").alias("count"), F.max("c").alias("c")).groupBy("t").agg(F.max_by("set", F.struct("count", "set")).alias("main"), F.count("*").alias("sets"), F.max("c").alias("c")).where("sets > 1")
    held = dealt(near, sizes, ["t"], "c", "cid").select("t", "cid", "n", "lone", "short", "comp", "g", (F.col("set") == F.col("main")).alias("in_main"))
    other = held.select("t", *[F.col(c).alias(f"{c}_2") for c in ("cid", "n", "lone", "short", "comp", "g")]).where("not in_main")
    # the greatest overlap that lone tokens allow
    most = "least(n - lone, n_2 - lone_2)"
    # each pair once from each side outside the main set; sizes decide which prefix is the short one
    fits = f"comp <> comp_2 and coalesce(g <> g_2, true) and (in_main or cid < cid_2) and if((n, cid) < (n_2, cid_2), short, short_2) and {den} * {most} >= {num} * (n + n_2 - {most})"
    found = held.join(other, "t").where(fits)
    return found.select(F.least("cid", "cid_2").alias("a"), F.greatest("cid", "cid_2").alias("b")).distinct()


def _linked(pairs: DataFrame, texts: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Of pairs(a, b) those that link."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            keep = np.zeros(len(a), dtype=bool)
            for i, (x, y) in enumerate(zip(shingle_sets(batch.column(2), k), shingle_sets(batch.column(3), k), strict=True)):
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep[i] = den * both >= num * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([pa.array(a[keep], pa.int64()), pa.array(b[keep], pa.int64())], ["a", "b"])

    pairs = written(pairs)
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct()
    if pairs.count() <= BROADCAST_ROWS // 2:
        texts = texts.join(F.broadcast(wanted), "cid", "left_semi")
    left = texts.select(F.col("cid").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("cid").alias("b"), F.col("text").alias("text_b"))
    held = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
    out = written(held.mapInArrow(rows, "a long, b long"))
    dropped(pairs)
    return out


def ngram_join(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5, heavy: int = HEAVY, hub_rounds: int = 1) -> DataFrame:
    """(doc_id, n_shingles, component_id, class_id, component) of every row of docs(doc_id, text).

    component_id: the smallest doc_id reachable by links; class_id: equal for equal sets; component: equal for what links join.
    """
    whole = written(class_rows(docs, k, num, den))
    base = written(whole.drop("prefix"))
    classes = written(whole.where("n > 0").groupBy("cid").agg(F.first("n").alias("n"), F.min("doc_id").alias("least"), F.first("prefix").alias("prefix")))
    dropped(whole)
    keys = _keys(classes, num, den, heavy)
    named = written(classes.drop("prefix"))
    dropped(classes)
    texts = _texts(docs, named.join(keys.select("cid").distinct(), "cid", "left_semi").select("cid", "least"), k)
    wide = _wide_tokens(keys.where("wide").select("cid").distinct(), texts, k)
    narrow = keys.where(F.col("c") <= heavy)
    fame = (F.sum("c").over(Window.partitionBy("cid")) / F.col("n")).alias("fame")
    wide_places = wide.select("t", "cid", "n", "c", F.lit(None).cast("long").alias("need"), fame)
    places = narrow.where("not wide").select("t", "cid", "n", "c", "need", fame).unionByName(wide_places)
    fits = f"{den} * least(n, m) >= {num} * greatest(n, m)"
    links: list[DataFrame] = []
    comps = apart = None

    def labelled(rows: DataFrame) -> DataFrame:
        if comps is None:
            return rows.withColumn("comp", F.col("cid"))
        return rows.join(comps, rows.cid == comps.node, "left").select(*rows.columns, F.coalesce("comp", "cid").alias("comp"))

    def grouped(rows: DataFrame) -> DataFrame:
        if apart is None:
            return rows.withColumn("g", F.lit(None).cast("long"))
        return rows.join(apart.select("cid", "g"), "cid", "left")

    def ends(x: str, y: str) -> list[F.Column]:
        return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]

    def hubs_of(rows: DataFrame) -> DataFrame:
        """(cid, hub): of each class the hub of most of its tokens; the hub of a token is its class of most fame. The final round
        forms all pairs, so a class that shares too little with its hub by these tokens alone has none here."""
        hubs = rows.groupBy("t").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max_by(F.struct("cid", "n", "comp", "need"), F.struct("fame", F.col("cid").alias("x"))).alias("h"), F.max("c").alias("c"))
        hubs = hubs.where("lo <> hi").select("t", F.col("h.cid").alias("hub"), F.col("h.n").alias("m"), F.col("h.comp").alias("hub_comp"), F.col("h.need").alias("hub_need"), "c")
        near = dealt(rows, hubs, ["t"], "c", "cid").where("comp <> hub_comp").where(fits)
        near = near.groupBy("cid", "hub").agg(F.count("*").alias("shared"), F.min(F.least("need", "hub_need")).alias("need")).where("shared >= coalesce(need, 1)")
        return near.groupBy("cid").agg(F.max_by("hub", F.struct("shared", "hub")).alias("hub"))

    for r in range(hub_rounds + 1):
        spare: list[DataFrame] = []
        if r < hub_rounds:
            # further rounds look for hubs in other components
            picked = written(hubs_of(labelled(places)))
            if apart is None:
                groups = _groups(wide, picked)
                apart = _apart(wide, groups, num, den)
                links.append(_group_links(apart, num, den))
                spare = [groups]
            pairs = picked.join(apart.select("cid"), "cid", "left_anti").select(*ends("cid", "hub")).distinct()
            spare.append(picked)
        else:
            now = labelled(narrow)
            sizes = now.groupBy("t", "comp").count().groupBy("t").agg(F.max_by("comp", F.struct("count", "comp")).alias("main"), F.count("*").alias("comps")).where("comps > 1")
            some = now.join(sizes, "t").where("comp <> main").select("t", F.col("cid").alias("x"), F.col("n").alias("m"), F.col("need").alias("need_x"), F.col("comp").alias("comp_x"), "main", F.col("wide").alias("wide_x"))
            found = some.join(now, "t").where("not (wide and wide_x) and comp <> comp_x and (comp = main or cid < x)").where(fits)
            light = found.groupBy(*ends("cid", "x")).agg(F.count("*").alias("shared"), F.min(F.least("need", "need_x")).alias("need")).where("shared >= need").select("a", "b")
            pairs = light.unionByName(_wide_pairs(grouped(labelled(wide)), num, den)).distinct()
        links.append(_linked(pairs, texts, k, num, den))
        dropped(comps, *spare)
        comps = components(reduce(DataFrame.unionByName, links))

    dropped(keys, texts, wide, apart, *links)
    placed = named.join(comps, named.cid == comps.node, "left").select("cid", "least", F.coalesce("comp", "cid").alias("comp"))
    lowest = placed.groupBy("comp").agg(F.min("least").alias("component_id"))
    owners = written(placed.join(lowest, "comp").select("cid", "component_id", "comp"))
    dropped(named, comps)
    none = F.lit(None).cast("long")
    out = base.where("n > 0").select("doc_id", F.col("n").alias("n_shingles"), "cid").join(owners, "cid").select("doc_id", "n_shingles", "component_id", F.col("cid").alias("class_id"), F.col("comp").alias("component"))
    alone = base.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), none.alias("class_id"), none.alias("component"))
    return out.unionByName(alone)


def keep_one(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """docs, one row of each component: one with the smallest doc_id (null only if the component has no other).

    If this id stands in several rows of the component, the one of the smallest class, then text, stays. Rows without words link with nothing, so
    they all stay. Each row is judged by its own text, also where rows share an id or have none. An empty table gives an empty table.
    """
    found = written(ngram_join(docs, k, num, den))
    names = found.groupBy("doc_id").agg(F.count("*").alias("rows"), F.max(F.expr("n_shingles = 0 or doc_id <=> component_id")).alias("keep"))
    once = names.where("rows = 1 and keep").select("doc_id")
    kept = docs.join(once, docs.doc_id.eqNullSafe(once.doc_id), "left_semi")
    # ids of several rows: by the class of each row
    several = names.where("rows > 1").select("doc_id")
    stay = found.where("n_shingles > 0 and doc_id <=> component_id").groupBy("component").agg(F.min(F.struct("class_id", "doc_id")).alias("x")).select(F.col("x.class_id").alias("_cid"), F.col("x.doc_id").alias("_id"))
    schema = docs.schema
    at = [f.lower() for f in schema.names].index("text")

    def classed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [class_of(tokens) if len(tokens) else None for tokens in shingle_sets(batch.column(at).cast(pa.large_string()), k)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.int64())], [*batch.schema.names, "_cid"])

    held = docs.join(several, docs.doc_id.eqNullSafe(several.doc_id), "left_semi").mapInArrow(classed, StructType([*schema.fields, StructField("_cid", LongType())]))
    wordless = held.where("_cid is null").drop("_cid")
    chosen = held.join(stay, (held["_cid"] == stay["_cid"]) & held["doc_id"].eqNullSafe(stay["_id"]), "left_semi")
    row = F.struct(*[F.col(f"`{c}`") for c in schema.names])
    chosen = chosen.groupBy("_cid").agg(F.min_by(row, F.struct("text", F.xxhash64(*[F.col(f"`{c}`") for c in schema.names]))).alias("row")).select("row.*")
    return kept.unionByName(wordless).unionByName(chosen)
