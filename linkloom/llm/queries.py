"""The queries op1_ to op13_: thin digests of the operators of this package, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import exact, licences, manifest, minhash, mixing, oracles, packing, pii, quality, sharding, substrings, vectors, whitening


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_information_theoretic_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents, and the terms beside it that would reveal it."""
    found = pii.find_personal_data(read(spark, sf_dir, "documents").select("doc_id", "text"), carry=["doc_id"])
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id", *[count(k).alias(f"n_{pii.KINDS[k]}") for k in range(4)], F.sha2(pii.joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), pii.joined(F.col("spans")).alias("spans")
    )


def op2_window_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the words of 20-word windows that start earlier too."""
    out = substrings.remove_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"), window=20)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op3_tiled_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings, linked at a cosine of 0.95 or more."""
    return vectors.near_duplicates(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"), threshold=0.95)


def op4_licence_dice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence lines of all documents: the best template of each line with a Dice coefficient of 0.75 or more."""
    return licences.scan(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_lpt_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into 8 shards of near equal bytes; equal texts stay together. Null text: 0 bytes plus 1."""
    docs = read(spark, sf_dir, "documents")
    text = F.coalesce(F.col("text"), F.lit(""))
    out = sharding.shard_groups(docs, 8, F.octet_length(text) + 1, F.xxhash64(text), keep={"text_crc32": F.crc32(text.cast("binary"))})
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_best_fit_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as token ids in sequences of at most 2048."""

    def tokenizer():
        import public_tokenizers

        return packing.word_tokenizer(public_tokenizers.path("word_bpe_49k.json"), end_id=1)

    pieces = packing.pack(read(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer, length=2048)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op7_subword_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents; learned from labelled documents that aren't held out."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = quality.fit(docs, labels.where(~quality.held_out()))
    scored = quality.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", quality.held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op8_water_filled_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to 150% of their words, weights 3, 1, 2 repeating, at most twice each source."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    out = mixing.mix(docs, lambda names, sizes: [(3.0, 1.0, 2.0)[i % 3] for i in range(len(names))], share=1.5, cap=2.0)
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op9_prefix_forest_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 rows with the largest inner product found for each row whose vec_id is divisible by 20."""
    return vectors.nearest(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0, k=20)


def op10_minhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, grouped at a Jaccard similarity of 0.8 or more of 2-word shingles."""
    return minhash.near_duplicate_groups(read(spark, sf_dir, "documents").select("doc_id", "text"), k=2, percent=80)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Merkle tree over all documents by language; each row's proof checked against its row as it is or was tampered with."""
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    tampered = F.when(chosen, manifest.leaf([F.col(f) + 1 if f == "n_chars" else F.col(f) for f in fields]))
    out = manifest.manifest(read(spark, sf_dir, "documents"), fields, "doc_id", "lang", carry={"doc_id": F.col("doc_id"), "tampered": tampered})
    out = out.withColumn("folded_root", manifest.fold(F.coalesce("tampered", "leaf"), F.col("proof")))
    proof = manifest.digest_of(F.array_join(manifest.siblings(F.col("proof")), ""))
    return out.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op12_exact_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, with the one of equal texts that stays."""
    out = exact.deduplicate(spark, f"{sf_dir}/documents.parquet")
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op13_jacobi_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings on their first 32 components, whitened."""
    return whitening.whiten(read(spark, sf_dir, "embeddings"), components=32)


QUERIES = {
    f.__name__: f
    for f in (
        op1_information_theoretic_pii, op2_window_dedup, op3_tiled_embedding_dedup, op4_licence_dice, op5_lpt_shards,
        op6_best_fit_packs, op7_subword_quality, op8_water_filled_mix, op9_prefix_forest_search, op10_minhash_groups, op11_merkle_manifest, op12_exact_stream, op13_jacobi_whitening,
    )
}
ORACLE: dict[str, str] = {
    "op2_window_dedup": oracles.windows(20),
    "op3_tiled_embedding_dedup": oracles.embeddings(0.95),
    "op4_licence_dice": licences.scan_sql(),
    "op10_minhash_groups": oracles.near_duplicates(80),
    "op11_merkle_manifest": oracles.merkle(),
    "op12_exact_stream": oracles.exact_copies(),
}
