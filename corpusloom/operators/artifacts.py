"""What a batch leaves behind: keyed replacement, isolated failures, content-addressed results, manifests, plans, vector rows.

Each gives DataFrames; a caller that wants files writes them. Where a folder of a table is replaced, it is by partition.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import text_of, truncate_bytes
from corpusloom.operators.windows import keep_least


def replaced(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The table with all rows of the keys that occur in ``rows`` replaced by those: delete by key, then insert."""
    return table.join(rows.select(key).distinct(), key, "left_anti").unionByName(rows.select(*table.columns))


def write_replaced(rows: DataFrame, path: str, key: str) -> None:
    """Replaces the partitions of the keys in ``rows`` in a table partitioned by key, and no others."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def isolated_counts(sources: DataFrame, rows: DataFrame, source: str, sound: Column) -> DataFrame:
    """(source, n) of every source: how many of its rows are written, 0 for none, and -1 if one of them isn't sound.

    A source that fails takes no other with it; its rows are those that :func:`sound_rows` leaves out.
    """
    counts = rows.groupBy(source).agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.coalesce(sound, F.lit(False))).alias("fine"))
    out = sources.select(source).distinct().join(counts, source, "left")
    return out.select(source, F.when(F.col("n").isNull(), 0).when(F.col("fine"), F.col("n")).otherwise(-1).alias("n"))


def sound_rows(rows: DataFrame, source: str, sound: Column) -> DataFrame:
    """Rows of the sources all of whose rows are sound."""
    failed = rows.filter(~F.coalesce(sound, F.lit(False))).select(source).distinct()
    return rows.join(failed, source, "left_anti")


def cache_key(task: Column, prompt_hash: Column, payload: Column, model: Column) -> Column:
    """sha256 of task, prompt, input and model as JSON with names in order; payload: JSON text whose names are in order."""
    inner = lambda c: F.regexp_extract(F.to_json(F.struct(c.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)
    return F.sha2(F.concat(F.lit('{"input":'), payload, F.lit(',"model":'), inner(model), F.lit(',"prompt_hash":'), inner(prompt_hash), F.lit(',"task":'), inner(task), F.lit("}")), 256)


def prompt_hash(prompt: Column) -> Column:
    """The front of a prompt's sha256."""
    return F.left(F.sha2(text_of(prompt), 256), F.lit(16))


def cached(wanted: DataFrame, cache: DataFrame, forced: Sequence[str] = ()) -> DataFrame:
    """wanted (key, task, ...) with ``output`` of the cache and ``hit``; a forced task's rows are misses whatever the cache has."""
    newest = keep_least(cache.select("key", "output", "created_at").withColumn("__o", -F.col("created_at").cast("long")), ["key"], [F.col("__o")])
    out = wanted.join(newest.select("key", F.struct("output").alias("__kept")), "key", "left")
    hit = F.col("__kept").isNotNull() & ~F.col("task").isin(*forced) if forced else F.col("__kept").isNotNull()
    return out.withColumn("hit", hit).withColumn("output", F.when(hit, F.col("__kept.output"))).drop("__kept")


def cache_stats(looked: DataFrame) -> DataFrame:
    """hits, misses and writes (a write for each missing key) by task."""
    return looked.groupBy("task").agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"), F.count_distinct(F.when(~F.col("hit"), F.col("key"))).alias("writes"))


def fingerprints(files: DataFrame, content: str = "content") -> DataFrame:
    """(path, sha256, bytes) of each file."""
    return files.select("path", F.sha2(content, 256).alias("sha256"), F.octet_length(content).cast("long").alias("bytes"))


def manifest(samples: DataFrame, label: str, labels: Sequence[str], key: str) -> DataFrame:
    """One row of a data set: how many samples there are, of each label (zero-filled), and a sha256 of its ids, in whatever order they come.

    The ids' hashes are added up, so nothing is gathered or ordered.
    """
    piece = lambda k: F.conv(F.substring(F.sha2(F.col(key).cast("string"), 256), 1 + 12 * k, 12), 16, 10).cast("decimal(38,0)")
    total = F.concat_ws("-", *(F.coalesce(F.sum(piece(k)), F.lit(0)).cast("string") for k in range(5)))
    counts = [F.count_if(F.col(label) == v).alias(f"n_{v}") for v in labels]
    return samples.agg(F.count(F.lit(1)).alias("n"), *counts, F.sha2(total, 256).alias("ids_sha256"))


def deletion_plan(files: DataFrame, title: str, name: str, full: Column, size: Column) -> DataFrame:
    """(title, delete, keep, keep_full): of the files of a title all but one go; nothing is deleted by this.

    The one that stays is a full one before others, the largest, the first by name. Files without a title all stay.
    """
    rows = files.filter(text_of(F.col(title)) != "").withColumn("__full", full)
    best = rows.groupBy(title).agg(F.min_by(F.struct(F.col(name).alias("keep"), F.col("__full").alias("keep_full")), F.struct(~F.col("__full"), -size, F.col(name))).alias("k"))
    return rows.join(best, title).filter(F.col(name) != F.col("k.keep")).select(title, F.col(name).alias("delete"), "k.keep", "k.keep_full")


def planned(files: DataFrame, plan: DataFrame, name: str, apply: bool = False) -> DataFrame:
    """The files that a plan leaves; without ``apply``, all of them."""
    return files.join(plan.select(F.col("delete").alias(name)), name, "left_anti") if apply else files


def vector_rows(chunks: DataFrame, key: str, most_bytes: int = 60_000, mark: str = "…") -> DataFrame:
    """(key, page_content, display_text, metadata) of chunks: what is embedded, what is shown, and all other fields as text.

    page_content is embedding_text, or text without it. Null fields are empty and nested ones JSON; each is cut at ``most_bytes``.
    """
    own = [f for f in chunks.schema.fields if f.name not in (key, "text", "embedding_text")]
    plain = lambda f: F.coalesce(F.col(f"`{f.name}`").cast("string") if f.dataType.typeName() not in ("array", "map", "struct") else F.to_json(f"`{f.name}`"), F.lit(""))
    cells = [x for f in own for x in (F.lit(f.name), truncate_bytes(plain(f), most_bytes, mark))]
    metadata = F.create_map(*cells) if cells else F.create_map().cast("map<string,string>")
    return chunks.select(key, F.coalesce(F.nullif("embedding_text", F.lit("")), "text", F.lit("")).alias("page_content"), truncate_bytes(F.col("text"), most_bytes, mark).alias("display_text"), metadata.alias("metadata"))


def owned(rows: DataFrame, user: Column | str, owner: str = "user_id") -> DataFrame:
    """A user's own rows; rows without an owner are nobody's."""
    return rows.filter(F.col(owner) == (F.lit(user) if isinstance(user, str) else user))


def session_messages(sessions: DataFrame, messages: DataFrame, asked: DataFrame) -> DataFrame:
    """The messages of asked (session_id, user_id), in order, of sessions that belong to who asks; others get none."""
    allowed = asked.join(sessions.select("session_id", "user_id"), ["session_id", "user_id"], "left_semi").select("session_id").distinct()
    return messages.join(allowed, "session_id", "left_semi")


def touched(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """sessions whose updated_at is that of their newest message, if that is later."""
    newest = messages.groupBy("session_id").agg(F.max("created_at").alias("__newest"))
    return sessions.join(newest, "session_id", "left").withColumn("updated_at", F.greatest("updated_at", "__newest")).drop("__newest")


def focus(category: Column, dimensions: Mapping[str, Sequence[str]], default: Sequence[str]) -> Column:
    """The review dimensions of a clause's category."""
    table = F.create_map(*(x for k, v in dimensions.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    return F.coalesce(F.try_element_at(table, category), F.array(*map(F.lit, default)))


def review_items(rows: DataFrame, kind: str, layer: str, title: Column, reason: Column, decision: Column, category: Column, body: Column, url: str = "url", source: str = "source") -> DataFrame:
    """Rows that a person has to look at, in one schema: a stable id, what and why, and an excerpt."""
    from corpusloom.functions.text import excerpt, stable_id

    own = lambda c: text_of(F.col(c)) if c in rows.columns else F.lit("")
    return rows.select(
        stable_id("review", F.lit(kind), own(url), title, reason).alias("review_id"),
        F.lit(kind).alias("kb_type"),
        F.lit(layer).alias("source_layer"),
        own(source).alias("source_site"),
        title.alias("title"),
        own(url).alias("url"),
        category.alias("review_category"),
        decision.alias("suggested_decision"),
        reason.alias("review_reason"),
        F.length(text_of(body)).alias("body_len"),
        excerpt(body, 500, ()).alias("excerpt"),
    )
