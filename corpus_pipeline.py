"""The corpus pipeline: five stages over `documents`, each an operator of ripplet.llm.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the columns of
`documents`; where a stage cuts text, `n_chars` follows it. Nulls: a null text is rejected by the first stage, as it has
no letter; rows without an id can't be compared by id and stay. Repeated rows of one id leave one. Empty tables pass
through every stage as empty tables. Further columns of `documents` are carried along.
"""

from pyspark.sql import functions as F

from ripplet.llm import bpe, decontam, langid, minhash, passages
from ripplet.llm.cluster import store


def _counted(docs):
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def language(spark, docs, sf_dir):
    """Documents whose language is told with enough certainty; the classifier learns from these documents' own labels."""
    model = langid.learn(docs.where(~F.coalesce(langid.held_out(), F.lit(False))), "text", "lang")
    cols = [F.col(f"`{c}`") for c in docs.columns]
    told = langid.identify(docs, "text", model, cols, ("\x01language", "\x01score", "\x01rejected"))
    # without a single label there is nothing to reject by but the lack of letters
    return told.where(~F.col("\x01rejected")).select(*cols) if model.languages else docs.where(F.col("text").rlike(r"\p{L}"))


def near_duplicates(spark, docs, sf_dir):
    """One document of each group of near duplicates, with a similarity of 0.8 or more: the one with the smallest id."""
    groups = minhash.near_duplicates(docs, percent=80)
    gone = groups.where("doc_id is not null and not kept").select("doc_id").distinct()
    left = docs.join(gone, "doc_id", "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
    return left.where("doc_id is not null").dropDuplicates(["doc_id"]).unionByName(left.where("doc_id is null"))


def repeated_passages(spark, docs, sf_dir):
    """Passages of 50 words or more that an earlier document has too are cut out."""
    return _counted(passages.remove_passages(docs, passages.repeated_passages(docs)))


def benchmark(spark, docs, sf_dir):
    """Passages of the benchmark are cut out."""
    return _counted(decontam.remove_hits(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def tokens(spark, docs, sf_dir):
    """The ids of every text, and proof that they decode to it."""
    return bpe.round_trip(docs, "doc_id", "text", *bpe.vocabulary(), keep_ids=True)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark", benchmark),
    ("tokens", tokens),
]

#: Language scores, passages and byte-pair ids can't be said in SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The stages one after another, each stored and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
