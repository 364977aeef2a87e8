"""The registered digest queries of this package and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kpiforge.llm import (automaton, edit_counts, licenses, oracle, packing, periodic, prefix_trie, quality, repeats, scaled_sketch,
                          simhash, simple8b, vector_index, wrapper)

BYTE_BPE, WORD_BPE = "byte_bpe_50k.json", "word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), BYTE_BPE)


def op2_quality_rules(spark, sf_dir):
    got = quality.judge(table(spark, sf_dir, "documents"))
    return got.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                      "base_failed", "kept", "n_line_words")


def op3_near_vectors(spark, sf_dir):
    return vector_index.near_vectors(table(spark, sf_dir, "embeddings"))


def op4_license_scan(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents"))


def op5_bpe_automaton(spark, sf_dir):
    return automaton.coded(table(spark, sf_dir, "documents"), WORD_BPE)


def op6_main_text(spark, sf_dir):
    return wrapper.extracted(table(spark, sf_dir, "pages"))


def op7_simhash(spark, sf_dir):
    got = simhash.simhash_groups(table(spark, sf_dir, "documents"))
    return got.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_repeats(spark, sf_dir):
    got = repeats.without_repeats(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op9_edit_counts(spark, sf_dir):
    """Counts before and after personal data is masked in every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return edit_counts.edited_counts(docs.withColumn("edits", edit_counts.pii_edits(F.col("text"))), BYTE_BPE)


def op10_id_files(spark, sf_dir):
    return simple8b.id_files(table(spark, sf_dir, "documents"), WORD_BPE)


def looped_tails(docs: DataFrame) -> DataFrame:
    """doc_id and text; in one document of ten (by the crc32 of its id) the words from a
    place on are replaced by a loop over some of them."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rows = docs.select("doc_id", "text", F.when(h % 10 == 0, words).alias("words"), g.alias("g"))
    n = F.size("words")
    rows = rows.withColumn("a", F.when(n > 0, F.col("g") % n))
    rows = rows.withColumn("p", 1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8)))
    looped = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(F.col("words"), F.when(
        i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")))
    return rows.select("doc_id", F.when(n > 0, F.array_join(looped, " ")).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark, sf_dir):
    got = periodic.periodic_runs(looped_tails(table(spark, sf_dir, "documents")))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","),
                                                   r["period"].cast("string"), F.lit("\n")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("l"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    got = got.withColumn("best", best)
    return got.select(
        F.col("id").alias("doc_id"), F.size("runs").cast("bigint").alias("n_runs"), (-F.col("best.s")).alias("start"),
        F.col("best.l").alias("length"), (-F.col("best.p")).alias("period"),
        F.expr("1000 * best.l div -best.p").alias("exponent_milli"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))


def rebuilt(placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns and conversations in which every conversation begins with the first h turns of
    the one whose id is its own less its remainder by 5, h the crc32 of its id modulo 9."""
    def head(c):
        return F.crc32(c.cast("string").cast("binary")) % 9

    base = F.col("conv_id") - F.pmod("conv_id", F.lit(5))
    convs = placed.groupBy("conv_id").agg((F.max("place") + 1).alias("n")).withColumn("base", base)
    family = convs.groupBy("base").agg(F.collect_list("conv_id").alias("members"),  # five at most
                                       F.coalesce(F.max(F.when(F.col("conv_id") == F.col("base"), F.col("n"))), F.lit(0)).alias("given"))
    h = head(F.col("conv_id"))
    convs = convs.join(family.select("base", "given"), "base").select(
        "conv_id", (F.least(h, "given") + F.greatest(F.col("n") - h, F.lit(0))).alias("n"))
    none = F.array().cast("array<struct<conv_id: bigint, place: bigint>>")
    own = F.when(F.col("place") >= h, F.array(F.struct("conv_id", (F.col("place") - h + F.least(h, "given")).alias("place")))).otherwise(none)
    given = F.when(F.col("conv_id") == F.col("base"), F.transform(
        F.filter("members", lambda c: F.col("place") < head(c)),
        lambda c: F.struct(c.alias("conv_id"), F.col("place").alias("place")))).otherwise(none)
    turns = placed.withColumn("base", base).join(family, "base").select(F.explode(F.concat(own, given)).alias("to"), "a", "b", "size")
    return turns.select("to.conv_id", "to.place", "a", "b", "size"), convs


def op12_prefix_trie(spark, sf_dir):
    turns, convs = rebuilt(prefix_trie.placed_turns(table(spark, sf_dir, "conversations")))
    return prefix_trie.prefix_nodes(turns, convs).drop("x", "y")


def op13_scaled_sketch(spark, sf_dir):
    docs = scaled_sketch.with_next(table(spark, sf_dir, "documents")).withColumn("n", F.length("text"))
    edited = F.concat(F.expr("substring(text, 1, n - n div 2)"), F.expr("substring(next_text, 1, n div 2)"))
    docs = docs.withColumn("edited", edited)
    docs = docs.withColumns({c: scaled_sketch.sketch(F.col(t)) for c, t in (("own", "text"), ("changed", "edited"), ("next", "next_text"))})
    return docs.select(
        F.col("id").alias("doc_id"), F.col("n").cast("bigint").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        scaled_sketch.as_text(F.col("own")).alias("fingerprint"), scaled_sketch.as_text(F.col("changed")).alias("edited_fingerprint"),
        scaled_sketch.likeness(F.col("own"), F.col("changed")).alias("near_edited"),
        scaled_sketch.likeness(F.col("own"), F.col("next")).alias("near_next"))


QUERIES = {f.__name__: f for f in (op1_packing, op2_quality_rules, op3_near_vectors, op4_license_scan,
                                   op5_bpe_automaton, op6_main_text, op7_simhash, op8_repeats,
                                   op9_edit_counts, op10_id_files, op11_periodic_runs, op12_prefix_trie,
                                   op13_scaled_sketch)}
SQL: dict[str, str] = {"op2_quality_rules": oracle.quality(), "op3_near_vectors": oracle.near_vectors(),
                       "op4_license_scan": oracle.license_scan(), "op11_periodic_runs": oracle.periodic_runs(),
                       "op12_prefix_trie": oracle.prefix_trie()}
