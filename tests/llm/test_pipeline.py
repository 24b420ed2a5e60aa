"""Each stage of the pipeline against brute force on what its predecessor kept, and the whole of it on odd tables."""

import hashlib
from collections import Counter

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F
from test_operators import ODD, brute_jaccard, plain_lines

import corpus_pipeline
from larkspur.llm import mixing, ngrams, quality
from larkspur.llm.queries import TARGETS, labelled_domains, word_vocabulary

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def made_documents():
    rng = np.random.default_rng(12)
    prose = {"en": "the river and stone of morning light is old quiet walks under", "de": "der fluss und stein ist alt das haus die strasse nicht", "fr": "le fleuve et la pierre est vieux de une maison dans", "es": "el rio y la piedra es viejo de una casa en"}
    rows = []
    for i in range(120):
        lang = ["en", "en", "en", "de", "fr", "es"][i % 6]
        words = [str(w) + (str(rng.integers(0, 40)) if rng.random() < 0.5 else "") for w in rng.choice(prose[lang].split(), 90)]
        rows.append((i, "\n".join(" ".join(words[k : k + 15]) + "." for k in range(0, 90, 15)), lang))
    rows += [(200 + i, "BUY!!! NOW!!! $$$ " * 30 + str(i), "en") for i in range(60)]
    rows += [(300 + i, rows[i][1] + " one more", rows[i][2]) for i in range(8)] + [(320 + i, rows[i][1], rows[i][2]) for i in range(4)]
    rows += [(380 + i, rows[50 + i][1].replace("\n", " ") + " more", rows[50 + i][2]) for i in range(8)]
    shared = "\n".join(rows[20][1].split("\n")[:4])
    rows += [(340 + i, f"{rows[40 + i][1][:200]}\n{shared}\nown ending {i}", "en") for i in range(3)]
    rows += [(400 + i, t, "en") for i, t in enumerate(ODD)] + [(5, rows[5][1], "de"), (5, "the stone and the other text of this id", "en"), (None, rows[6][1], "en"), (None, None, None)]
    return [(i, t, lang, f"src{(i or 0) % 3}", None if t is None else len(t)) for i, t, lang in rows]


def write(spark, folder, rows, labels, extra=()):
    df = spark.createDataFrame(rows, SCHEMA)
    for c in extra:
        df = df.withColumn(c, F.lit("mine"))
    df.repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


LABELS = [(i, 1, 0) for i in range(120)] + [(200 + i, 0, 0) for i in range(60)] + [(0, 1, 0), (3, None, 0), (None, 0, 0)]
KEY = ("doc_id", "text", "lang", "source")


def rows_of(df, *columns):
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


def test_stages_against_brute_force(spark, tmp_path):
    folder = write(spark, tmp_path, made_documents(), LABELS)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)

    # the filter: every text packed by either dictionary, one piece after another
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "quality")
    model = quality.fit(docs, labels.filter(~quality.held_out("doc_id")))
    good, bad = (zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False) for d in (model.good, model.bad))

    def stays(text):
        data = (text or "").encode()
        pieces = [data[a : a + quality.PIECE] for a in range(0, len(data), quality.PIECE)]
        more = sum(len(bad.compress(p)) - len(good.compress(p)) for p in pieces)
        return model.slope * more / max(len(data), 1) + model.offset >= 0

    kept = stage["quality"](spark, docs, folder)
    assert rows_of(kept, *KEY) == Counter({k: n for k, n in rows_of(docs, *KEY).items() if stays(k[1])})
    ids = {r["doc_id"] for r in kept.collect()}
    assert ids >= set(range(120)) and not ids & set(range(200, 260))
    kept.write.parquet(f"{folder}/0")

    # lines: by order of id, each id and text once
    docs = spark.read.parquet(f"{folder}/0")
    out = stage["lines"](spark, docs, folder)
    single = sorted({(r["doc_id"], r["text"]) for r in docs.collect()}, key=lambda k: (k[0] is not None, k[0] or 0))
    assert len({i for i, t in single if t}) >= len([1 for i, t in single if t]) - 2  # two texts share an id; they share no line
    cleaned = dict(zip(single, (t for t, _ in plain_lines([t for _, t in single]))))
    assert rows_of(out, "doc_id", "text") == Counter({k: n for r, n in rows_of(docs, "doc_id", "text").items() for k in [(r[0], cleaned[r])]}) and out.columns == docs.columns
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in out.collect())
    out.write.parquet(f"{folder}/1")

    # near copies: all pairs of distinct texts; a class keeps its smallest id
    docs = spark.read.parquet(f"{folder}/1")
    out = stage["near copies"](spark, docs, folder)
    rows = sorted(((r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] is not None), key=lambda r: (r[0], r[1] or ""))
    classes = brute_jaccard([t for _, t in rows])
    groups = {}
    for i, row in enumerate(rows):
        groups.setdefault(classes[i][0], set()).add(row)
    stayed = rows_of(out, "doc_id", "text")
    for i, own in groups.items():
        mine = [r for r in own if r in stayed]
        # one text of each class, under its smallest id
        assert [r[0] for r in mine] == [min(own)[0]] or not ngrams.shingles(rows[i][1]).size and set(mine) == own
    assert {r["doc_id"] for r in out.collect()} & {*range(380, 388)} == set()  # near copies in one line each
    out.write.parquet(f"{folder}/2")

    # mixing: nothing goes, nothing is repeated more than the bound, the rates' shares are the targets', and rows follow the rates
    docs = spark.read.parquet(f"{folder}/2")
    out = stage["mixing"](spark, docs, folder)
    before, after = rows_of(docs, *KEY), rows_of(out, *KEY)
    assert set(before) == set(after) and all(before[k] <= after[k] <= (mixing.MOST + 1) * before[k] for k in before) and out.columns == docs.columns
    rated = {(r["_key"]["id"], r["_key"]["text"]): r for r in mixing.rates(docs, labelled_domains(docs, spark.read.parquet(f"{folder}/labels.parquet")), TARGETS, least=1.0).collect()}
    hashed = docs.select(*KEY, F.xxhash64("text").alias("h"), (F.pmod(F.xxhash64("doc_id", "text", F.lit(6)), F.lit(1 << 20)) / float(1 << 20)).alias("share")).collect()
    assert after == Counter({tuple(r[c] for c in KEY): before[tuple(r[c] for c in KEY)] * int(np.floor(rated[r["doc_id"], r["h"]]["rate"] + r["share"])) for r in hashed})
    total = Counter()
    for r in hashed:
        own = rated[r["doc_id"], r["h"]]
        for d, p in own["domain_posteriors"].items():
            total[d] += own["rate"] * own["n_tokens"] * p
    assert {d: n / sum(total.values()) for d, n in total.items()} == pytest.approx(TARGETS, abs=0.02)
    out.write.parquet(f"{folder}/3")

    # encoding: the library
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(word_vocabulary())
    t.no_truncation()
    t.no_padding()
    docs = spark.read.parquet(f"{folder}/3")
    for r in stage["encoding"](spark, docs, folder).join(docs.select("doc_id", "text").distinct(), "doc_id").collect():
        ids = t.encode(r["text"] or "", add_special_tokens=False).ids
        if r["doc_id"] != 5:
            assert r["ids"] == ids and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()

    # and all of it in one run
    whole = corpus_pipeline.run(spark, folder)
    assert rows_of(whole, "doc_id", "ids_sha256") == rows_of(stage["encoding"](spark, docs, folder), "doc_id", "ids_sha256")


def test_pipeline_of_empty_tables_and_without_labels(spark, tmp_path):
    assert corpus_pipeline.run(spark, write(spark, tmp_path / "a", [], [])).count() == 0
    rows = [r for r in made_documents() if r[0] is not None and r[0] < 260][::5] + made_documents()[-14:]
    folder = write(spark, tmp_path / "b", rows, [], extra=("label", "spans", "_own", "_rate", "id", "rep", "fold", "hash", "lines_removed"))
    out = corpus_pipeline.run(spark, folder)
    assert {r["doc_id"] for r in out.collect()} >= {r[0] for r in rows if r[0] is not None and 200 <= r[0] < 260 and r[0] % 5 == 0} - {205, 210, 215, 220, 225, 230, 235, 240, 245, 250, 255}
    assert {"label", "spans", "_own", "_rate", "id", "rep", "fold", "hash"} <= set(out.columns) and {r["spans"] for r in out.collect()} == {"mine"}
