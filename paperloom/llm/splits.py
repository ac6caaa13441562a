"""Splits that keep related records together.

Records that share a student or a source file, directly or through others,
are one component. Components are found by label propagation with pointer
jumping over the few links between students. A new split is searched by
annealing over whole components: start from a hashed assignment, move or
exchange components while the deviation in size and labels falls, in blocks
and several runs side by side, and keep the best. The blocks are drawn anew
in each round, so any two components can come to be exchanged.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.common import blank_trim, checkpoint, norm_path, table

SALT = 16
BLOCK = 2000  # components annealed together in a round
HEAVY = 1000  # components over 1 / HEAVY of the rows, so fewer than that many, are placed among themselves first
# So many of the most frequent labels count each by itself; all others count too, by their hash in as many groups.
LABELS = 32


def student_number(c: Column) -> Column:
    """The number in a student_id without leading zeros, null if there is none."""
    digits = F.regexp_extract(c, r"(\d+)", 1)
    return F.when(digits != "", F.regexp_replace(digits, r"^0+(?=\d)", ""))


def split_name(c: Column) -> Column:
    """One spelling per split; empty is null."""
    s = F.lower(blank_trim(c))
    return F.when(s == "training", "train").when(s.isin("valid", "validation"), "val").when(s != "", s)


def connect(links: DataFrame) -> DataFrame:
    """(node, root) of every node of the undirected links (a, b); root is the least node of its component.

    Each round takes the least label among neighbours, then the label's
    label; rounds are cut by a checkpoint and end when no label changes.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = checkpoint(both)
    labels = checkpoint(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")).withColumnRenamed("a", "node"))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), F.col("root").alias("r")).hint("merge"), "b").groupBy("a").agg(F.min("r").alias("r"))
        step = labels.join(near.withColumnRenamed("a", "node").hint("merge"), "node", "left").select("node", F.least("root", F.coalesce("r", "root")).alias("new"), F.col("root").alias("old"))
        up = labels.select(F.col("node").alias("new"), F.col("root").alias("jump"))
        moved = checkpoint(step.join(up.hint("merge"), "new", "left").select("node", F.least("new", F.coalesce("jump", "new")).alias("root"), "old"))
        labels = moved.select("node", "root")
        if moved.filter(F.col("root") != F.col("old")).isEmpty():
            return labels


def components(rows: DataFrame) -> DataFrame:
    """(file_name, source, student_id, page_kind, split, student, path, component) of each row; other columns are left out.

    Null links nothing: a row without student and source is alone (with rows
    of the same file_name, which can only agree or be its copies). What is
    joined to the rows is one row per linked student or per source; hot
    students and sources are salted on the row side, and joins are merges of
    sorted sides: these tables grow with the input, so none is broadcast.
    """
    rows = rows.select("file_name", "source", "student_id", "page_kind", "split")
    rows = rows.withColumn("student", student_number(F.col("student_id"))).withColumn("path", F.nullif(norm_path(F.col("source")), F.lit("")))
    # one row per source: its least student, combined before the shuffle
    pairs = rows.filter(F.col("student").isNotNull() & F.col("path").isNotNull()).select("student", "path").distinct()
    least = pairs.groupBy("path").agg(F.min("student").alias("first"), F.max("student").alias("last"))
    shared = least.filter(F.col("first") != F.col("last")).select("path", "first")
    links = pairs.join(shared.hint("merge"), "path").filter(F.col("student") != F.col("first")).select(F.col("student").alias("a"), F.col("first").alias("b")).distinct()
    roots = connect(links)
    owner = least.select("path", F.col("first").alias("owner"))
    salt = F.pmod(F.hash("file_name"), F.lit(SALT))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)))
    alone = rows.filter(F.col("student").isNull()).withColumn("salt", salt).join(owner.withColumn("salt", salts).hint("merge"), ["path", "salt"], "left")
    keyed = rows.filter(F.col("student").isNotNull()).withColumn("salt", salt).withColumn("owner", F.col("student")).unionByName(alone)
    mapped = keyed.join(roots.select(F.col("node").alias("owner"), "root").withColumn("salt", salts).hint("merge"), ["owner", "salt"], "left")
    key = F.coalesce(
        F.concat(F.lit("s:"), F.coalesce("root", "owner")), F.concat(F.lit("p:"), F.col("path")), F.concat(F.lit("f:"), F.coalesce("file_name", F.lit("")))
    )
    return mapped.withColumn("component", key).drop("owner", "root", "salt")


def parted(grouped: DataFrame) -> DataFrame:
    """Rows of components that hold two or more different splits at present."""
    named = grouped.withColumn("_split", split_name(F.col("split")))
    bad = named.filter(F.col("_split").isNotNull()).select("component", "_split").distinct().groupBy("component").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("component")
    salted = bad.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return named.withColumn("_salt", F.pmod(F.hash("file_name"), F.lit(SALT))).join(salted.hint("merge"), ["component", "_salt"], "left_semi").drop("_salt", "_split")


def _scale(sums: np.ndarray) -> np.ndarray:
    """Weight of a deviation in rows and in each label."""
    scale = 1.0 / np.maximum(sums, 1.0)
    scale[0] *= 3  # the number of rows counts more than any label
    return scale


def _anneal(sizes: np.ndarray, start: np.ndarray, target: np.ndarray, seed: int, moves: int, scale: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Whole components moved or exchanged between splits; (assignment, cost), the best seen."""
    rng = np.random.default_rng(seed)
    n, k = len(sizes), len(target)
    scale = _scale(sizes.sum(axis=0)) if scale is None else scale
    now = start.copy()
    total = np.zeros_like(target)
    np.add.at(total, now, sizes)
    dev = (total - target) * scale
    w = sizes * scale
    cost = float((dev**2).sum())
    best, best_cost = now.copy(), cost
    if k < 2 or not n:
        return best, best_cost
    pick, other, to, luck = rng.integers(0, n, moves), rng.integers(0, n, moves), rng.integers(1, k, moves), rng.random(moves)
    heat = max(cost / n, 1e-300)
    enough = (0.5 * scale[0]) ** 2  # not a row off in all
    for t in range(moves):
        if best_cost < enough:
            break
        i, j = pick[t], other[t]
        a = now[i]
        swap = t & 1
        if swap:
            b = now[j]
            if a == b:
                continue
            d = w[i] - w[j]
        else:
            b = (a + to[t]) % k
            d = w[i]
        da, db = dev[a] - d, dev[b] + d
        change = float((da @ da) + (db @ db) - (dev[a] @ dev[a]) - (dev[b] @ dev[b]))
        if change <= 0 or luck[t] < math.exp(-change / (heat * (1 - t / moves) ** 2 + 1e-300)):
            now[i] = b
            if swap:
                now[j] = a
            dev[a], dev[b] = da, db
            cost += change
            if cost < best_cost * (1 - 1e-12):
                best, best_cost = now.copy(), cost
    return best, best_cost


def _label_counts(grouped: DataFrame, label: str) -> list[Column]:
    """Columns to sum per component: rows, each of the frequent labels, all others by groups."""
    kind = F.coalesce(F.lower(F.trim(label)), F.lit(""))
    top = [r[0] for r in grouped.groupBy(kind.alias("k")).count().orderBy(F.desc("count"), "k").limit(LABELS + 1).collect()]
    counts = [F.lit(1)] + [(kind == x).cast("int") for x in top[:LABELS]]
    if len(top) > LABELS:
        group = F.when(~kind.isin(top[:LABELS]), F.pmod(F.xxhash64(kind), F.lit(LABELS)))
        counts += [F.coalesce(group == g, F.lit(False)).cast("int") for g in range(LABELS)]
    return counts


def new_splits(grouped: DataFrame, targets: DataFrame, label: str = "page_kind", runs: int = 4, moves: int = 12000, rounds: int = 4) -> DataFrame:
    """(component, new_split): shares of rows and of each label near the targets, no component parted.

    targets: (split, share); null, repeated or non-positive ones are left out
    and the rest scaled to 1; without any, new_split is null. The heavy
    components are placed first; then each round deals all components into
    blocks of about BLOCK, anneals every block towards its part of what is
    uneven in the whole, and takes each block's best run; the best round counts. Only totals by split reach the driver.
    """
    wanted = sorted((r.split, float(r.share)) for r in targets.select(split_name(F.col("split")).alias("split"), "share").filter("split is not null and share > 0").groupBy("split").agg(F.max("share").alias("share")).collect())
    if not wanted:
        return grouped.select("component").distinct().withColumn("new_split", F.lit(None).cast("string"))
    names = [s for s, _ in wanted]
    share = np.array([x for _, x in wanted])
    share = share / share.sum()
    counts = _label_counts(grouped, label)
    cols = [f"c{i}" for i in range(len(counts))]
    sums = grouped.groupBy("component").agg(*[F.sum(c).alias(n) for n, c in zip(cols, counts, strict=True)])
    # the hashed assignment the search starts from
    u = F.pmod(F.xxhash64("component"), F.lit(1_000_003)) / F.lit(1_000_003.0)
    place = F.lit(0)
    for edge in np.cumsum(share)[:-1]:
        place = place + (u >= float(edge)).cast("int")
    now = checkpoint(sums.withColumn("split", place))

    def totals(assigned: DataFrame) -> tuple[np.ndarray, int]:
        got = assigned.groupBy("split").agg(*[F.sum(c).alias(c) for c in cols], F.count(F.lit(1)).alias("n")).collect()
        out = np.zeros((len(share), len(cols)))
        for r in got:
            out[r.split] = [r[c] for c in cols]
        return out, sum(r.n for r in got)

    total, n = totals(now)
    if not n:
        return now.select("component", F.lit(None).cast("string").alias("new_split"))
    wish = share[:, None] * total.sum(axis=0)[None, :]
    scale = _scale(total.sum(axis=0))
    cost_of = lambda t: float((((t - wish) * scale) ** 2).sum())
    blocks = max(1, math.ceil(n / BLOCK))
    best, best_cost = now, cost_of(total)
    schema = "component string, block int, run int, cost double, split int"

    def anneal(uneven: np.ndarray, turn: int):
        def one(key, pdf):
            pdf = pdf.sort_values("component", ignore_index=True)
            sizes, start = pdf[cols].to_numpy(dtype=float), pdf["split"].to_numpy()
            target = np.zeros_like(uneven)
            np.add.at(target, start, sizes)
            found, cost = _anneal(sizes, start, target - uneven, 7919 * int(key[0]) + 31 * (turn + 1) + int(key[1]), max(moves, 6 * len(sizes)), scale)
            return pd.DataFrame({"component": pdf["component"], "block": int(key[0]), "run": int(key[1]), "cost": cost, "split": found})

        return one

    for turn in range(-1, rounds):
        if turn < 0:
            # a component larger than a block's part of the whole can't be placed by looking at that part
            heavy = now.filter(F.col("c0") * HEAVY > float(total[:, 0].sum()))
            block, part = F.lit(0), heavy
            got, _ = totals(heavy)
            off = got - share[:, None] * got.sum(axis=0)[None, :]
        else:
            block, part, off = F.pmod(F.xxhash64(F.lit(turn), "component"), F.lit(blocks)).cast("int"), now, (total - wish) / blocks
        dealt = part.withColumn("block", block).withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))))
        tried = checkpoint(dealt.groupBy("block", "run").applyInPandas(anneal(off, turn), schema))
        pick = tried.groupBy("block").agg(F.min(F.struct("cost", "run")).alias("x")).select("block", F.col("x.run").alias("run"))
        chosen = tried.join(pick.hint("merge"), ["block", "run"], "left_semi").select("component", "split")
        moved = now.withColumnRenamed("split", "before").join(chosen.hint("merge"), "component", "left")
        now = checkpoint(moved.select("component", *cols, F.coalesce("split", "before").alias("split")))
        total, _ = totals(now)
        if cost_of(total) < best_cost:
            best, best_cost = now, cost_of(total)
        if turn >= 0 and np.abs(total - wish).max() <= 1:
            break
    return best.select("component", F.element_at(F.array(*[F.lit(s) for s in names]), F.col("split") + 1).alias("new_split"))


def _grouped(spark, d):
    return components(table(spark, d, "sample_manifest"))


def p1_found(spark, d):
    return parted(_grouped(spark, d)).select("file_name").filter(F.col("file_name").isNotNull()).distinct()


def p1_assigned(spark, d):
    """Each file with its component and new split."""
    grouped = checkpoint(_grouped(spark, d))
    return grouped.select("file_name", "component").distinct().join(new_splits(grouped, table(spark, d, "split_targets")).hint("merge"), "component")


def p1_balance(spark, d):
    """Of each split wanted: whether the new one has its share of the rows to a hundredth, and how many students and sources are parted."""
    grouped = checkpoint(_grouped(spark, d))
    targets = table(spark, d, "split_targets").select(split_name(F.col("split")).alias("new_split"), "share").filter("new_split is not null and share > 0").groupBy("new_split").agg(F.max("share").alias("share"))
    want = targets.select("new_split", (F.col("share") / F.sum("share").over(Window.partitionBy())).alias("wanted"))  # one row per split
    split = checkpoint(new_splits(grouped, table(spark, d, "split_targets")))
    placed = grouped.groupBy("component").agg(F.count(F.lit(1)).alias("n")).join(split.hint("merge"), "component")
    per = placed.groupBy("new_split").agg(F.sum("n").alias("n"))
    per = per.select("new_split", (F.col("n") / F.sum("n").over(Window.partitionBy())).alias("got"))
    # told from the records' own keys, not from the components
    keyed = grouped.select("component", F.explode(F.array(F.concat(F.lit("s:"), "student"), F.concat(F.lit("p:"), "path"))).alias("key")).filter("key is not null").distinct()
    parted_keys = keyed.join(split.hint("merge"), "component").groupBy("key").agg(F.countDistinct("new_split").alias("n")).filter("n > 1").count()
    return want.join(per, "new_split", "left").select("new_split", "wanted", (F.abs(F.coalesce("got", F.lit(0.0)) - F.col("wanted")) < 0.01).alias("balanced"), F.lit(parted_keys).cast("bigint").alias("n_parted"))


QUERIES = {"p1_found": p1_found, "p1_assigned": p1_assigned, "p1_balance": p1_balance}

SQL = {
    "p1_found": r"""
WITH RECURSIVE r AS (
  SELECT file_name, CASE WHEN regexp_extract(student_id, '(\d+)') <> '' THEN 's:' || regexp_replace(regexp_extract(student_id, '(\d+)'), '^0+([0-9])', '\1') END AS st,
    'p:' || nullif(regexp_replace(replace(lower(trim(source)), '\', '/'), '^(\./+)+', ''), '') AS p,
    CASE lower(trim(split)) WHEN 'training' THEN 'train' WHEN 'valid' THEN 'val' WHEN 'validation' THEN 'val' ELSE nullif(lower(trim(split)), '') END AS sp
  FROM sample_manifest),
m AS (SELECT p, min(st) AS first FROM r WHERE st IS NOT NULL AND p IS NOT NULL GROUP BY 1),
l AS (SELECT DISTINCT r.st AS a, m.first AS b FROM r JOIN m USING (p) WHERE r.st IS NOT NULL),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
reach(n, o) AS (SELECT a, a FROM e UNION SELECT reach.n, e.b FROM reach JOIN e ON reach.o = e.a),
root AS (SELECT n, min(o) AS o FROM reach GROUP BY 1),
g AS (
  SELECT r.file_name, r.sp, coalesce(root.o, r.st, m.first, r.p, 'f:' || r.file_name) AS k0, r.st, m.first
  FROM r LEFT JOIN m USING (p) LEFT JOIN root ON root.n = coalesce(r.st, m.first)),
bad AS (SELECT k0 FROM g GROUP BY 1 HAVING count(DISTINCT sp) > 1)
SELECT DISTINCT file_name FROM g WHERE k0 IN (SELECT k0 FROM bad) AND file_name IS NOT NULL""",
    "p1_balance": """
WITH t AS (
  SELECT CASE lower(trim(split)) WHEN 'training' THEN 'train' WHEN 'valid' THEN 'val' WHEN 'validation' THEN 'val' ELSE nullif(lower(trim(split)), '') END AS new_split, max(share) AS share
  FROM split_targets WHERE split IS NOT NULL AND share > 0 GROUP BY 1)
SELECT new_split, share / sum(share) OVER () AS wanted, true AS balanced, CAST(0 AS BIGINT) AS n_parted FROM t WHERE new_split IS NOT NULL""",
}
