"""References to records that do not exist at the time of the reference.

Keys are hashed and cut into ranges of that hash. The parents of a range (life spans of records) come as one sorted
array, with spans of a key merged where they touch, first within days and then in all; the references of the range
come as vectorised batches and are probed by binary search on (key, time). A range with many references is dealt in
blocks, each with its own copy of the range's parents, so a name that a third of all rows refer to is no task's burden.
There are as many tasks as blocks, each of bounded size whatever the size of the tables; a task holds the parents of one
block and one batch of references at a time. Misses only are aggregated.

Defined results: null and blank names are no references; a reference with a null repo_id has no record; a null recorded_at counts as before all time; a null
first_seen_at as since ever; repeated rows count once; columns beyond those named are ignored; an empty parent table
makes every reference missing; empty references give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import blank_trim, cut

PARENTS_PER_RANGE = 50_000
REFERENCES_PER_BLOCK = 50_000
#: Stand-ins for "since ever" and "never ended", in microseconds.
EVER, NEVER = -(2**62), 2**62


def _micros(c: str, missing: int) -> Column:
    return F.coalesce(F.unix_micros(F.col(c).cast("timestamp")), F.lit(missing))


def _dotted(c: Column) -> Column:
    return F.regexp_replace(blank_trim(c), r"\?\.|::", ".")


def _parts(c: Column) -> Column:
    return F.filter(F.split(c, r"::|[./]"), lambda x: x != "")


def _hashed(df: DataFrame) -> DataFrame:
    return df.withColumn("h", F.xxhash64("space", "repo_id", "key"))


def _range(ranges: int) -> Column:
    """Hash ranges of equal width: xxhash64 is uniform, so these are its quantiles."""
    return F.floor((F.shiftrightunsigned("h", 32).cast("double") / F.lit(2.0**32)) * F.lit(ranges)).cast("int")


def _module_path(path: Column) -> tuple[Column, Column]:
    """Parts of a module's path without its extension, and of its folder; index files stand for their folder."""
    clean = F.regexp_replace(path, r"^(\./)+", "")
    folder = F.regexp_replace(clean, r"/?[^/]*$", "")
    base = F.regexp_replace(F.regexp_replace(clean, r"^.*/", ""), r"(?<=.)\.[^.]*$", "")
    stands = base.isin("__init__", "index", "mod")
    return _parts(F.when(stands, folder).otherwise(F.concat(folder, F.lit("/"), base))), folder


def parents(symbols: DataFrame) -> DataFrame:
    """(space, repo_id, key, born, died) of all life spans: F callables, T types, M modules by each end of their path."""
    life = [_micros("first_seen_at", EVER).alias("born"), _micros("deleted_at", NEVER).alias("died")]
    named = symbols.where(F.col("qualified_name").isNotNull())
    calls = named.where(F.col("kind").isin("function", "method", "class")).select(F.lit("F").alias("space"), "repo_id", F.col("qualified_name").alias("key"), *life)
    types = named.where(F.col("kind").isin("class", "interface")).select(F.lit("T").alias("space"), "repo_id", F.col("qualified_name").alias("key"), *life)
    parts, _ = _module_path(F.col("file_path"))
    ends = F.transform(F.sequence(F.lit(1), F.size("p")), lambda i: F.array_join(F.slice("p", i, F.size("p")), "."))
    modules = (
        symbols.where((F.col("kind") == "module") & F.col("file_path").isNotNull())
        .select("repo_id", parts.alias("p"), *life)
        .where(F.size("p") > 0)
        .select(F.lit("M").alias("space"), "repo_id", F.explode(F.concat(ends, F.array(F.concat(F.lit("/"), F.array_join("p", "."))))).alias("key"), "born", "died")
    )
    return calls.unionByName(types).unionByName(modules)


def call_references(calls: DataFrame, runtime_symbols: DataFrame) -> DataFrame:
    known = runtime_symbols.agg(F.collect_set("qualified_name").alias("k"))  # a fixed table
    name = _dotted(F.col("callee_name"))
    qualified = F.regexp_replace(F.coalesce(F.col("caller_id"), F.lit("")), r"^.*?::", "")
    scope = F.regexp_replace(qualified, r"(^|\.)[^.]*$", "")
    own = name.rlike(r"^(self|this|cls)\.")
    rest = F.regexp_replace(name, r"^(self|this|cls)\.", "")
    key = F.when(own & (scope != ""), F.concat(scope, F.lit("."), rest)).when(own, rest).otherwise(name)
    refs = calls.select(F.lit("calls").alias("table_name"), F.col("call_id").alias("ref_id"), "repo_id", F.lit("F").alias("space"), key.alias("key"), _micros("recorded_at", EVER).alias("at"), F.col("recorded_at").alias("recorded_at"))
    return refs.where("key is not null and key <> ''").where(~F.array_contains(known.scalar(), F.col("key")))


def inheritance_references(inheritance: DataFrame, runtime_symbols: DataFrame) -> DataFrame:
    known = runtime_symbols.where(F.col("kind").isin("class", "interface")).agg(F.collect_set("qualified_name").alias("k"))
    key = blank_trim(F.regexp_replace(_dotted(F.col("parent_name")), r"(?s)[<\[].*$", ""))
    refs = inheritance.select(F.lit("inheritance").alias("table_name"), F.col("inherit_id").alias("ref_id"), "repo_id", F.lit("T").alias("space"), key.alias("key"), _micros("recorded_at", EVER).alias("at"), F.col("recorded_at").alias("recorded_at"))
    return refs.where("key is not null and key <> ''").where(~F.array_contains(known.scalar(), F.col("key")))


def import_references(imports: DataFrame, known_packages: DataFrame) -> DataFrame:
    known = known_packages.agg(F.collect_set(blank_trim(F.col("package_name"))).alias("k"))  # a fixed table
    src = F.col("src")
    # every beginning of the module that ends at a separator, and the module itself
    pieces = F.split(src, r"(?=[./]|::)")
    heads = F.transform(F.sequence(F.lit(1), F.size(pieces)), lambda i: F.array_join(F.slice(pieces, F.lit(1), i), ""))
    python = F.lower("file_path").endswith(".py")
    slashed = F.regexp_extract("src", r"^(?:\.{1,2}/)+", 0)
    bare = F.when(~python & src.isin(".", ".."), F.concat(src, F.lit("/"))).otherwise(slashed)
    dots = F.length(F.regexp_extract("src", r"^\.+", 0))
    ups = F.when(bare != "", F.size(F.split(F.concat(F.lit("/"), bare), r"\.\./")) - 1).when(python & (dots > 0), dots - 1)
    rest = F.when(bare != "", F.substring(src, F.length(bare) + 1, F.length(src))).when(python, F.regexp_replace("src", r"^\.+", "")).otherwise(src)
    levels = F.filter(F.split("folder", "/"), lambda x: (x != "") & (x != "."))
    above = F.slice("levels", F.lit(1), F.greatest(F.lit(0), F.size("levels") - F.col("ups")))
    absolute = F.array_join(_parts(F.regexp_replace("rest", r"^crate::", "")), ".")
    relative = F.concat(F.lit("/"), F.array_join(F.concat(F.flatten(F.transform("above", _parts)), _parts(F.col("rest"))), "."))
    return (
        imports.select("import_id", "repo_id", blank_trim(F.col("source_module")).alias("src"), F.regexp_replace(F.coalesce("file_path", F.lit("")), r"^(\./)+", "").alias("file_path"), "recorded_at")
        .where("src is not null and src <> ''")
        .where(~F.arrays_overlap(heads, known.scalar()))
        .withColumn("folder", F.regexp_replace("file_path", r"/?[^/]*$", ""))
        .withColumns({"ups": ups, "rest": rest, "levels": levels})
        .withColumn("above", above)
        .withColumn("key", F.when(F.col("ups").isNull(), absolute).when(F.col("ups") > F.size("levels"), F.lit("//")).otherwise(relative))
        .select(F.lit("imports").alias("table_name"), F.col("import_id").alias("ref_id"), "repo_id", F.lit("M").alias("space"), "key", _micros("recorded_at", EVER).alias("at"), "recorded_at")
        .where("key <> ''")
    )


def _names(p: pd.DataFrame) -> np.ndarray:
    return (p["space"].astype(object) + "\0" + p["repo_id"].astype(object) + "\0" + p["key"].astype(object)).to_numpy(object)


def _merged(p: pd.DataFrame) -> tuple[np.ndarray, ...]:
    """Parents of one range as arrays sorted by (h, key, born), touching spans of a key merged: (h, key, born, died, first end)."""
    p = p.sort_values(["h", "space", "repo_id", "key", "born"], kind="stable")
    name = _names(p)
    changed = np.append(True, name[1:] != name[:-1])
    name, group = pd.Series(name, p.index), pd.Series(changed.cumsum(), p.index)
    reach = p.groupby(group)["died"].cummax()
    fresh = (p["born"] > reach.groupby(group).shift()) | changed
    span = fresh.cumsum()
    first = p.groupby(span).agg(h=("h", "first"), born=("born", "first"), died=("died", "max"))
    return first["h"].to_numpy(), name.groupby(span).first().to_numpy(object), first["born"].to_numpy(), first["died"].to_numpy(), p.groupby(group)["first_end"].min().repeat(first.groupby(group.groupby(span).first().to_numpy()).size()).to_numpy()


def _probe(refs: pd.DataFrame, parents: tuple[np.ndarray, ...] | None) -> pd.DataFrame:
    """The references of a batch for which no span is open, with the reason."""
    out = refs[["table_name", "ref_id", "recorded_at"]].copy()
    out["reason"] = "missing"
    if not len(refs) or parents is None:
        return out
    h, key, born, died, ended = parents
    name = _names(refs)
    rh, at = refs["h"].to_numpy(), refs["since"].to_numpy()
    lo, hi = np.searchsorted(h, rh, "left"), np.searchsorted(h, rh, "right")
    same = lo < hi
    probe = np.minimum(lo, len(h) - 1)
    clash = same & ((key[probe] != name) | (key[np.maximum(hi - 1, 0)] != name))
    for i in np.flatnonzero(clash):  # two names with one hash
        own = np.flatnonzero(key[lo[i] : hi[i]] == name[i])
        lo[i], hi[i] = (lo[i] + own[0], lo[i] + own[-1] + 1) if len(own) else (lo[i], lo[i])
    same = lo < hi
    start, a, b = lo.copy(), lo.copy(), hi.copy()  # the last span that began at or before the reference
    while (open_ := a < b).any():
        mid = (a + b) // 2
        right = open_ & (born[np.minimum(mid, len(born) - 1)] <= at)
        a = np.where(right, mid + 1, a)
        b = np.where(open_ & ~right, mid, b)
    at_or_before = a - 1
    alive = same & (at_or_before >= start) & (at < died[np.maximum(at_or_before, 0)])
    gone = same & (ended[np.minimum(start, len(ended) - 1)] <= at)
    out["reason"] = np.where(~same, "missing", np.where(gone, "deleted", "late"))
    return out[~alive]


def _walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Misses of sorted rows: of each block first the parents, then its references, a batch at a time."""
    block, own, parents = None, [], None
    for b in batches:
        place = b["block"].to_numpy()
        ends = [*(np.flatnonzero(place[1:] != place[:-1]) + 1).tolist(), len(b)]
        for first, last in zip([0, *ends[:-1]], ends):
            part = b.iloc[first:last]
            if not len(part):
                continue
            if place[first] != block:
                block, own, parents = place[first], [], None
            is_parent = part["table_name"].isna().to_numpy()
            if is_parent.any():
                own.append(part[is_parent].rename(columns={"since": "born", "until": "died"}))
            if not is_parent.all():
                if own:
                    parents, own = _merged(pd.concat(own)), []
                yield _probe(part[~is_parent], parents)


def _spans(spans: DataFrame) -> DataFrame:
    """Life spans of each key, those that touch and begin on one day as one."""
    day = F.floor(F.col("born") / F.lit(86_400 * 1_000_000))
    fold = F.aggregate(
        F.array_sort(F.collect_set(F.struct("born", "died"))),
        F.array().cast("array<struct<born:bigint,died:bigint>>"),
        lambda done, x: F.when((F.size(done) > 0) & (x["born"] <= F.element_at(done, -1)["died"]), F.array_append(F.slice(done, F.lit(1), F.size(done) - 1), F.struct(F.element_at(done, -1)["born"].alias("born"), F.greatest(F.element_at(done, -1)["died"], x["died"]).alias("died")))).otherwise(F.array_append(done, x)),
    )
    # what decides between deleted and late is the earliest end of all spans, merged or not
    per = spans.groupBy("space", "repo_id", "key", day.alias("day")).agg(fold.alias("s"), F.min("died").alias("first_end"))
    return per.select("space", "repo_id", "key", "first_end", F.explode("s").alias("s")).select("space", "repo_id", "key", "s.born", "s.died", "first_end")


def orphans(references: DataFrame, spans: DataFrame) -> DataFrame:
    """(table_name, ref_id, recorded_at, reason) of each reference without a living record, each once."""
    refs = cut(_hashed(references.withColumn("repo_id", F.coalesce(F.col("repo_id").cast("string"), F.lit("")))))
    parents = cut(_hashed(_spans(spans.where("repo_id is not null and key is not null").withColumn("repo_id", F.col("repo_id").cast("string")))))
    n_refs, n_parents = refs.count(), parents.count()
    ranges = max(1, -(-n_parents // PARENTS_PER_RANGE), -(-2 * n_refs // REFERENCES_PER_BLOCK))
    # ranges that a hot key has filled get more blocks, numbered after those of all ranges; they are few, at most n_refs / REFERENCES_PER_BLOCK
    hot = refs.groupBy(_range(ranges).alias("range")).agg(F.ceil(F.count("*") / REFERENCES_PER_BLOCK).cast("int").alias("blocks")).where("blocks > 1").orderBy("range").collect()
    first = np.cumsum([ranges, *(r["blocks"] - 1 for r in hot)])
    table = F.broadcast(references.sparkSession.createDataFrame([(r["range"], r["blocks"], int(a)) for r, a in zip(hot, first)], "range int, blocks int, first int"))
    turn = F.pmod(F.xxhash64("table_name", "ref_id"), F.coalesce("blocks", F.lit(1)))
    block = F.when(turn == 0, F.col("range")).otherwise(F.col("first") + turn - 1).cast("int")
    blocks = F.concat(F.array("range"), F.when(F.col("blocks") > 1, F.sequence(F.col("first"), F.col("first") + F.col("blocks") - 2)).otherwise(F.array().cast("array<int>")))
    dealt = refs.withColumn("range", _range(ranges)).join(table, "range", "left").select(block.alias("block"), "h", "space", "repo_id", "key", F.col("at").alias("since"), F.lit(None).cast("bigint").alias("until"), F.lit(None).cast("bigint").alias("first_end"), "table_name", "ref_id", "recorded_at")
    copies = parents.withColumn("range", _range(ranges)).join(table, "range", "left").select(F.explode(blocks).alias("block"), "h", "space", "repo_id", "key", F.col("born").alias("since"), F.col("died").alias("until"), "first_end", *(F.lit(None).cast(t).alias(c) for c, t in (("table_name", "string"), ("ref_id", "bigint"), ("recorded_at", "timestamp"))))
    tasks = int(first[-1])
    sorted_ = dealt.unionByName(copies.withColumn("recorded_at", F.col("recorded_at").cast(dict(dealt.dtypes)["recorded_at"]))).repartitionById(tasks, "block").sortWithinPartitions("block", F.col("table_name").isNotNull(), "h", "key", "since")
    misses = sorted_.mapInPandas(_walk, f"table_name string, ref_id bigint, recorded_at {dict(dealt.dtypes)['recorded_at']}, reason string")
    return misses.dropDuplicates(["table_name", "ref_id", "recorded_at", "reason"])


def all_orphans(calls: DataFrame, imports: DataFrame, inheritance: DataFrame, symbols: DataFrame, runtime_symbols: DataFrame, known_packages: DataFrame) -> DataFrame:
    refs = call_references(calls, runtime_symbols).unionByName(import_references(imports, known_packages)).unionByName(inheritance_references(inheritance, runtime_symbols))
    return orphans(refs, parents(symbols))


def by_month(found: DataFrame) -> DataFrame:
    """(table_name, month, reason, n) of the orphans."""
    return found.groupBy("table_name", F.date_format("recorded_at", "yyyy-MM").alias("month"), "reason").agg(F.countDistinct("ref_id").alias("n"))
