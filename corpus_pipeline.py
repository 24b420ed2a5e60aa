"""The corpus pipeline: quality filter, line dedup, near-dedup, mixing and encoding, one after another.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and is written and read again
before the next one. All but the last return the columns of documents.

Defined cases, for every stage: null texts count as empty (the filter scores them as such, no line goes, they are near copies of nothing,
have no tokens and stay once); repeated rows are copies of one another, and near-dedup keeps rows that share an id and a text together
if theirs is the smallest id; ties go to the smallest id; rows with a null id are kept unless they are copies of a document with one;
empty tables give an empty table; without labels nothing is rejected and nothing is repeated; further columns pass through all stages
but the last, whose own columns replace those of their names.
"""

import os
import tempfile
import uuid

from pyspark.sql import functions as F

from larkspur.llm import bpe, lines, mixing, ngrams, quality
from larkspur.llm.common import read
from larkspur.llm.queries import TARGETS, labelled_domains, word_vocabulary

#: The score from which a document stays: more likely good than bad, so that clean documents stay.
STAYS = 0.5


def keep_quality(spark, docs, sf_dir):
    """Documents that the compression classifier holds to be good rather than bad. Without labels of both kinds all stay."""
    labels = read(spark, sf_dir, "labels").select("doc_id", "quality")
    return quality.keep_good(docs, quality.fit(docs, labels.filter(~quality.held_out("doc_id"))), accept=STAYS)


def drop_repeated_lines(spark, docs, sf_dir):
    """Later repeats of three consecutive lines go; n_chars follows the text."""
    cleaned = lines.line_dedup(docs)
    length = F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("bigint"))
    return cleaned.withColumn("n_chars", length).select(*docs.columns) if "lines_removed" not in docs.columns else cleaned.withColumn("n_chars", length)


def drop_near_copies(spark, docs, sf_dir):
    """One document of each class of near copies stays: the one of smallest id."""
    return ngrams.first_of_each(docs)


def mix_domains(spark, docs, sf_dir):
    """Documents of scarce languages are repeated until the languages' tokens have the target shares, mixing.MOST times at most; none goes."""
    rated = mixing.rates(docs, labelled_domains(docs, read(spark, sf_dir, "labels")), TARGETS, least=1.0)
    return mixing.apply_rates(docs, rated)


def encode(spark, docs, sf_dir):
    """Ids and digests instead of the text."""
    return bpe.encode_decode(docs, word_vocabulary(), outputs=("ids", "n_tokens", "ids_sha256", "decoded_sha256"))


STAGES = [
    ("quality", keep_quality),
    ("lines", drop_repeated_lines),
    ("near copies", drop_near_copies),
    ("mixing", mix_domains),
    ("encoding", encode),
]

#: No SQL packs texts with a dictionary, so tests hold the stages against brute force.
ORACLE_SQL = None


def shared_folder(spark) -> str:
    """A new folder in the session's checkpoint folder; one of this machine only where that is unset and Spark is local."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="spark-pipeline-", dir=os.environ.get("TMPDIR"))
    return f"{shared.rstrip('/')}/pipeline-{uuid.uuid4().hex}"


def remove(spark, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def run(spark, sf_dir):
    """The rows of the last stage. What a stage returns is written to the shared folder, and removed when the next one has been written;
    the last stage's input stays for whoever reads the result, under the folder of checkpoints.
    """
    folder = shared_folder(spark)
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{i}")
            docs = spark.read.parquet(f"{folder}/{i}")
            if i:
                remove(spark, f"{folder}/{i - 1}")
    return docs
