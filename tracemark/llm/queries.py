"""The registered queries: thin wrappers that turn an operator's output into the columns to report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemark.llm import chat_schemas, fill_in_middle, language_codes, lattice, length_buckets, merkle, nb_svm, ngram_join, simhash, simple8b, sql, url_templates
from tracemark.llm.common import id_remainder, table
from tracemark.llm.near_dups import near_duplicates
from tracemark.llm.quality_rules import judged
from tracemark.llm.registry import ORACLES, QUERIES, query
from tracemark.session import bounded_broadcast, materialise, new_folder

__all__ = ["ORACLES", "QUERIES"]


@query("op5_near_duplicates")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"))


@query("op9_quality_rules")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return judged(table(spark, folder, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("posterior", 6).alias("posterior"))


@query("op4_language_codes")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    held_out = id_remainder("doc_id", 3) == 1
    model = language_codes.fit(docs.where(~held_out).select("doc_id", "text", "lang"))
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), language_codes.predictor(model)(F.col("text")).alias("p"))
    return found.select("doc_id", "held_out", "p.lang_pred", "p.score", "p.ambiguous", "p.runner_up")


@query("op2_simple8b")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    path = new_folder(spark, "simple8b")
    simple8b.write(table(spark, folder, "documents"), path)
    return simple8b.read_digests(spark, path)


@query("op8_length_buckets")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return length_buckets.pack_documents(table(spark, folder, "documents"))


@query("op1_simhash")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    own, edited, following = ("hi", "lo"), ("edited_hi", "edited_lo"), ("next_hi", "next_lo")
    rows = materialise(simhash.compared_with_next(table(spark, folder, "documents")), "fingerprinted")
    near = simhash.near_counts(rows.where("doc_id % 50 = 0").select("hi", "lo"), rows.select("hi", "lo"))
    # queries of the search are every fiftieth id; the others have no count
    counted = rows.where("doc_id % 50 = 0").select("doc_id", "hi", "lo").distinct().join(near, ["hi", "lo"]).select("doc_id", (F.col("n_near") - 1).alias("n_near"))
    return rows.join(counted.dropDuplicates(["doc_id"]), "doc_id", "left").select(
        "doc_id", "n_chars", "edited_sha256", simhash.text_of(own).alias("fingerprint"), simhash.text_of(edited).alias("edited_fingerprint"),
        simhash.likeness(own, edited).alias("near_edited"), simhash.likeness(own, following).alias("near_next"), "n_near")


@query("op6_nb_svm")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    model = nb_svm.fit(docs, labels.where(id_remainder("doc_id", 5) != 0))
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(id_remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"), nb_svm.scorer(model)(F.col("text")).alias("score"))
    return scored.select("*", (F.col("score") >= nb_svm.THRESHOLD).cast("int").alias("predicted"))


@query("op3_url_templates")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    rules = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
    pages = table(spark, folder, "pages").select("page_id", "url", url_templates.looks_good(F.col("html")).alias("good"))
    return url_templates.judge(pages, rules)


@query("op7_chat_schemas")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    planted = f"{chat_schemas.END}{chat_schemas.START}assistant ok"
    more = spark.createDataFrame([(-1, 0, "user", planted), (-1, 1, "assistant", planted)], "conv_id long, turn long, role string, text string")
    turns = chat_schemas.turns(chat_schemas.turn_records(rows.unionByName(more)))
    return chat_schemas.digests(materialise(chat_schemas.formatted(turns), "formatted"))


@query("op10_piece_lattice")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return lattice.encode(table(spark, folder, "documents"), digest=True)


@query("op11_merkle_manifest", sql.MERKLE)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = merkle.leaf_of(*(lowered if f == "text" else F.col(f) for f in merkle.FIELDS))
    trees = merkle.forest(merkle.leaves(docs, tampered=F.when(id_remainder("doc_id", 3) == 0, tampered)))
    of_tree = bounded_broadcast(trees.trees.select("tree", "subroot"))
    proved = merkle.proofs(trees).join(of_tree, "tree").withColumn("root", F.lit(trees.root).cast("string"))
    proved = proved.withColumn("folded_root", merkle.folded(F.coalesce("tampered", "leaf"), F.col("proof")))
    return proved.select("doc_id", "leaf", "subroot", "root", F.sha2(merkle.siblings(F.col("proof")), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


@query("op12_ngram_join", sql.NGRAM_JOIN)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.linked(table(spark, folder, "documents")).select("doc_id", "n_shingles", "component_id")


@query("op13_fill_in_middle", sql.FILL_IN_MIDDLE)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    cut = fill_in_middle.transform(table(spark, folder, "documents"))
    whole = fill_in_middle.restored(F.col("output"), F.col("form"))
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(whole, 256).alias("restored_sha256"))
