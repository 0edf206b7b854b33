"""Columns of several tables matched by what they hold, and tables bound by the match."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from fnmatch import fnmatchcase

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean_string, jaro_winkler_distance, osa_distance, shingles

FIXED = ("sheet_id", "row", "col", "data_block", "value", "table_tag")
#: Distinct strings that stand for a column in comparisons, by hash order.
REPRESENTATIVES = 500


def representatives(df: DataFrame, columns: list[str], most: int = REPRESENTATIVES) -> DataFrame:
    """(name, value): distinct cleaned strings of each column, at most `most` by a hash, so the choice never varies."""
    cells = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), clean_string(F.col(c).cast("string")).alias("value")) for c in columns])).alias("c")).select("c.name", "c.value").where("value is not null")
    w = Window.partitionBy("name").orderBy(F.xxhash64("value"), "value")
    return cells.distinct().withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= most).drop("_k")


def _summary(c: str) -> Column:
    return (12 * F.median(c) + 6 * F.avg(c) + F.min(c) + F.max(c)) / 20


def similarity(x: DataFrame, y: DataFrame, extended: bool = False, symmetric: bool = False) -> DataFrame:
    """(name_1, name_2, levenshtein, overlap, charset[, osa, qgram, soundex, jaro_winkler]) distances of all column pairs.

    Distances between strings are summed up as (12 median + 6 mean + min + max) / 20 over the pairs of strings. Columns are
    few and have REPRESENTATIVES strings at most, which bounds the pairs."""
    a, b = x.select(F.col("name").alias("name_1"), F.col("value").alias("x")), y.select(F.col("name").alias("name_2"), F.col("value").alias("y"))
    pairs = a.join(F.broadcast(b), F.lit(True)).withColumn("d", F.levenshtein("x", "y").cast("double"))
    parts = {"levenshtein": _summary("d")}
    if extended:
        p, q = shingles(F.col("x")), shingles(F.col("y"))
        pairs = pairs.withColumn("o", osa_distance(F.col("x"), F.col("y")).cast("double")).withColumn("j", 1 - F.size(F.array_intersect(p, q)) / F.size(F.array_union(p, q)))
        pairs = pairs.withColumn("s", (F.soundex("x") != F.soundex("y")).cast("double")).withColumn("w", jaro_winkler_distance(F.col("x"), F.col("y")))
        parts |= {"osa": _summary("o"), "qgram": _summary("j"), "soundex": _summary("s"), "jaro_winkler": _summary("w")}
    strings = pairs.groupBy("name_1", "name_2").agg(*[v.alias(k) for k, v in parts.items()])

    def sets(df: DataFrame, name: str, value: str, out: str) -> DataFrame:
        chars = F.array_distinct(F.flatten(F.collect_set(F.split(F.lower(value), ""))))
        return df.groupBy(name).agg(F.collect_set(value).alias(f"{out}v"), F.array_remove(chars, "").alias(f"{out}c"))

    both = sets(a, "name_1", "x", "a").join(F.broadcast(sets(b, "name_2", "y", "b")), F.lit(True))

    def apart(k: str) -> Column:
        size = (F.size(f"a{k}") + F.size(f"b{k}")) / 2 if symmetric else F.size(f"a{k}")
        return F.greatest(F.lit(0.0), F.when(size > 0, 1 - F.size(F.array_intersect(f"a{k}", f"b{k}")) / size).otherwise(1.0))

    both = both.select("name_1", "name_2", apart("v").alias("overlap"), apart("c").alias("charset"))
    return strings.join(both, ["name_1", "name_2"])


def normalised(measured: DataFrame) -> DataFrame:
    """Adds dist, the mean of the metrics after each is scaled to 0..1 over all pairs; a constant one becomes 1 above a half, else 0."""
    names = [c for c in measured.columns if c not in ("name_1", "name_2")]
    w = Window.partitionBy(F.lit(1))
    scaled = []
    for c in names:
        lo, hi = F.min(c).over(w), F.max(c).over(w)
        scaled.append(F.when(hi > lo, (F.col(c) - lo) / (hi - lo)).when(F.col(c) > 0.5, 1.0).otherwise(0.0))
    return measured.withColumn("dist", sum(scaled[1:], scaled[0]) / len(names))


def greedy(pairs: list[tuple[str, str, float]]) -> list[tuple[str, str, float]]:
    """Repeatedly takes all pairs at the smallest distance, then leaves out their columns."""
    out, rest = [], sorted(pairs, key=lambda p: (p[2], p[0], p[1]))
    while rest:
        least = rest[0][2]
        taken = [p for p in rest if p[2] == least]
        out += taken
        first, second = {p[0] for p in taken}, {p[1] for p in taken}
        rest = [p for p in rest if p[0] not in first and p[1] not in second]
    return out


def without_doubles(profiles: DataFrame) -> DataFrame:
    """Profiles without those columns whose strings are the same as an earlier column's, by name."""
    marks = profiles.groupBy("name").agg(F.array_join(F.array_sort(F.collect_set("value")), "\u0001").alias("profile"))
    first = marks.withColumn("_k", F.row_number().over(Window.partitionBy("profile").orderBy("name"))).where("_k = 1")
    return profiles.join(F.broadcast(first.select("name")), "name", "left_semi")  # columns are few


@dataclass
class Collated:
    """The bound table, and where its columns come from: (new_name, old_name, frame, existed, iteration)."""

    frame: DataFrame
    column_map: list[tuple[str, str, str, bool, int]] = field(default_factory=list)


def collate_two(x: DataFrame, y: DataFrame, threshold: float = 1.0, fixed: tuple[str, ...] = FIXED, common_names: bool = False, rest_cols: float = float("inf"), keep_others: bool = False, extended: bool = False, iteration: int = 1, tuner: Callable[[DataFrame], DataFrame] | None = None, drop_doubles: bool = False) -> Collated:
    """Binds two tables: matched columns become collated_k in order of distance, the others uncollated_k. tuner: changes the
    (name, value) profiles before they are compared; drop_doubles: columns of a table with one profile count once."""
    stay = [c for c in x.columns if c in y.columns and (c in fixed or common_names)]
    left, right = ([c for c in d.columns if c not in stay] for d in (x, y))
    if not left or not right:
        return Collated(x.unionByName(y, allowMissingColumns=True))
    profiles = [representatives(d, names) for d, names in ((x, left), (y, right))]
    if drop_doubles:
        profiles = [without_doubles(p) for p in profiles]
    if tuner:
        profiles = [tuner(p) for p in profiles]
    measured = normalised(similarity(*profiles, extended)).select("name_1", "name_2", "dist").collect()
    matched = greedy([(r[0], r[1], round(r[2], 12)) for r in measured])
    near = [p for p in matched if p[2] <= threshold]
    forced = [p for p in matched if p[2] > threshold][: int(min(rest_cols, len(matched)))] if rest_cols != float("inf") else []
    name_x, name_y, seen_x, seen_y = {}, {}, set(), set()
    rows = []
    k = 0
    for a, b, _ in [*near, *forced]:
        if a in seen_x or b in seen_y:
            continue
        k += 1
        seen_x.add(a)
        seen_y.add(b)
        name_x[a] = name_y[b] = f"collated_{k}"
    u = 0
    for names, columns in ((name_x, left), (name_y, right)):
        for c in columns:
            if c not in names:
                u += 1
                names[c] = c if keep_others else f"uncollated_{u}"
    for tag, names in (("n1", name_x), ("n2", name_y)):
        rows += [(new, old, tag, old.startswith(("collated_", "uncollated_")), iteration) for old, new in names.items()]
    return Collated(x.withColumnsRenamed(name_x).unionByName(y.withColumnsRenamed(name_y), allowMissingColumns=True), rows)


def collate_columns(frames: list[DataFrame], threshold: float = 1.0, fixed: tuple[str, ...] = FIXED, **options: object) -> Collated:
    """Folds the tables from the left. One table alone has its columns renamed collated_1.. in their order."""
    if not frames:
        raise ValueError("Given composed_data has no known format")
    if len(frames) == 1:
        names = {c: f"collated_{k}" for k, c in enumerate((c for c in frames[0].columns if c not in fixed), 1)}
        return Collated(frames[0].withColumnsRenamed(names), [(new, old, "n1", False, 1) for old, new in names.items()])
    out = Collated(frames[0])
    for k, frame in enumerate(frames[1:], 1):
        step = collate_two(out.frame, frame, threshold, fixed, iteration=k, **options)
        out = Collated(step.frame, [*out.column_map, *step.column_map])
    front = [c for c in out.frame.columns if c in fixed]
    return Collated(out.frame.select(*front, *sorted(c for c in out.frame.columns if c not in fixed)), out.column_map)


def collate_blocks(composed: DataFrame, by: str = "data_block", threshold: float = 1.0, **options: object) -> Collated:
    """Collates one composed table: its blocks, each without the columns in which it holds nothing. The names of blocks and
    of their columns come from one small job."""
    names = [c for c in composed.columns if c not in FIXED]
    found = composed.groupBy(by).agg(*[F.count(c).alias(c) for c in names]).orderBy(by).collect()
    fixed = [c for c in composed.columns if c in FIXED]
    return collate_columns([composed.where(F.col(by).eqNullSafe(r[by])).select(*fixed, *[c for c in names if r[c]]) for r in found], threshold, **options)


def picked(df: DataFrame, *columns: str | Column) -> list[str]:
    """The names of columns given as names, as Columns or as patterns such as `N_*`, in the table's order."""
    shown = [c if isinstance(c, str) else df.select(c).columns[0] for c in columns]
    return [c for c in df.columns if any(fnmatchcase(c, s) for s in shown)]


def string_signatures(df: DataFrame, column: str) -> DataFrame:
    """(signature, value): values that clean to one string, and the largest of them."""
    return df.select(clean_string(F.col(column)).alias("signature"), F.col(column).alias("value")).where("value is not null").groupBy("signature").agg(F.max("value").alias("value"))


def longest_common_substring(a: str, b: str) -> Column:
    """Of two string columns the longest common substring, the first in `a` of equals; without Python."""
    n = F.length(a)
    every = F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.transform(F.sequence(F.lit(1), F.greatest(n - i + 1, F.lit(1))), lambda k: F.struct(k.alias("size"), (-i).alias("at"), F.substring(F.col(a), i, k).alias("s")))))
    return F.coalesce(F.array_max(F.filter(every, lambda e: F.contains(F.col(b), e.s))).s, F.lit(""))
