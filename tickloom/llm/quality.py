"""Quality classifier by compression: zstandard dictionaries of good and of bad labelled text.

Every text is cut into chunks of whole bytes, and each chunk is compressed once with the dictionary built from good text and
once with that from bad text. The difference of the sizes, normalised by the bytes of the text (and without what any frame costs), is all
that the score sees: a logistic curve of its inverse hyperbolic sine calibrates it to a probability. Normalised by the
compressed sizes instead, texts that compress badly with either dictionary would be hard to tell (bad texts right 95 % in place of all).

Bounded parameters: the dictionaries come from at most CHUNKS chunks of labelled training rows of each class, the curve
from at most ROWS labelled training rows of each class that gave no chunk; rows are drawn by a hash of the id. Scoring
covers all rows and whole texts. Where a class has too few chunks to train a dictionary on, their plain text serves as one.

Defined results: a null or empty text scores as a text without evidence (difference 0); without labels of both classes
the score is 0.5; repeated ids of labels count by their smallest label; repeated rows of documents repeat; extra columns are ignored,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm import _logistic
from tickloom.llm._common import cut, fold

CHUNK, CHUNKS, ROWS = 1024, 4_000, 4_000
DICTIONARY, LEVEL = 64 << 10, 3
#: Bits a byte of difference from which the curve grows by its logarithm.
SCALE = 20.0


def drawn(labels: DataFrame, label: str, most: int) -> DataFrame:
    """At most ``most`` labelled rows of each class, by a hash of the id."""
    return labels.where(F.col(label) == 1).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).unionAll(
        labels.where(F.col(label) == 0).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    )


def dictionaries(docs: DataFrame, labels: DataFrame) -> dict[int, bytes]:
    """A zstandard dictionary for each class, from the labelled rows given."""
    import zstandard

    text = docs.select("doc_id", "text").join(F.broadcast(drawn(labels, "y", CHUNKS)), "doc_id")
    parts = F.posexplode(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0)))
    chunks = text.select("y", "doc_id", parts.alias("at", "chunk")).withColumn("h", F.xxhash64("doc_id", "at"))
    out = {}
    for y in (0, 1):
        found = chunks.where((F.col("y") == y) & (F.char_length("chunk") >= 8)).orderBy("h", "chunk").limit(CHUNKS)
        samples = [r.chunk.encode() for r in found.select("chunk").collect()]
        try:
            out[y] = zstandard.train_dictionary(DICTIONARY, samples, level=LEVEL).as_bytes()
        except zstandard.ZstdError:  # too few samples to train on: their plain text serves as the dictionary
            out[y] = b"".join(samples)[-DICTIONARY:]
    return out


def differences(docs: DataFrame, made: dict[int, bytes]) -> DataFrame:
    """doc_id and difference of all rows: how much longer a byte is with the bad dictionary than with the good one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        compress = []
        for y in (0, 1):
            d = zstandard.ZstdCompressionDict(made[y])
            d.precompute_compress(level=LEVEL)
            compress.append(zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_dict_id=False).compress)
        frame = [len(c(b"")) for c in compress]
        for batch in batches:
            out = []
            for t in batch.column(1):
                raw = (t.as_py() or "").encode()
                n = max(1, -(-len(raw) // CHUNK))
                step = -(-len(raw) // n) or 1
                more = 0
                for lo in range(0, len(raw), step):
                    part = raw[lo : lo + step]
                    more += len(compress[0](part)) - frame[0] - len(compress[1](part)) + frame[1]
                out.append(more / len(raw) if raw else 0.0)
            yield pa.record_batch([batch.column(0), pa.array(out, pa.float64())], names=["doc_id", "difference"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, difference double")


def classify(docs: DataFrame, labels: DataFrame, parts: int = 4, held: int = 2, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted; labels (doc_id, quality) with the held-out remainder are not looked at."""
    known = (
        labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), parts) != held))
        .groupBy("doc_id")
        .agg(F.min("quality").cast("int").alias("y"))
        .withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(2)))
    )
    made = dictionaries(docs, known.where("half = 0").drop("half"))
    x = cut(differences(docs, made))
    sample = x.join(F.broadcast(drawn(known.where("half = 1").drop("half"), "y", ROWS)), "doc_id").select("y", "difference")
    rows = np.array([tuple(r) for r in sample.collect()], np.float64).reshape(-1, 2)
    if len(set(rows[:, 0])) == 2:
        bent = np.arcsinh(SCALE * rows[:, 1])
        # The sample holds classes in equal numbers at most: weights bring back the classes' shares.
        shares = {r.y: r["count"] for r in known.groupBy("y").count().collect()}
        weight = np.array([shares[int(y)] / (rows[:, 0] == y).sum() for y in rows[:, 0]])
        beta = _logistic.fit(bent[:, None], rows[:, 0], weight / weight.mean(), ridge=1e-3)
        score = _logistic.score([F.asinh(F.col("difference") * SCALE)], beta)
    else:
        score = F.lit(0.5)
    return x.select(
        "doc_id", (fold(F.col("doc_id"), parts) == held).alias("held_out"), score.alias("score"), "difference"
    ).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
