"""Lexical search: an inverted index with positions, web-search syntax, BM25, and fusion with vector search.

Texts become stemmed terms with their positions. The index is cut into shards of whole documents; within one, a row per term lists its documents
with counts, lengths and positions, so it is made where the texts are read and no posting is shuffled one by one. Queries are a table: their literals (words and
phrases, negated or not, in alternatives) are worked out by columns and counted; the rows of their terms are found by a broadcast join and meet by shard, where
every query is matched and its best documents stay. What is shuffled is thus the asked part of the index and k rows per query and shard, however
many documents match.

Web-search syntax: words must all occur; "a phrase" must stand as it is; ``or`` separates alternatives; ``-word`` and ``-"a phrase"`` must not occur.
An alternative without anything that must occur finds nothing. A document is scored by the wanted terms of all alternatives.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from larkspur.session import checkpoint

#: Fixed values of BM25.
K1, B = 1.2, 0.75
#: Literals of a batch of queries that go to the tasks at once; more are searched in parts.
MOST_LITERALS = 100_000
#: Words of a shard, after which it ends with its document.
SHARD_WORDS = 2_000_000

WORD = r"[\p{L}\p{N}]+"

Stemmer = Callable[[Column], Column]


def words(text: Column) -> Column:
    """The lower-cased words of a text, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def plural_stem(word: Column) -> Column:
    """A word without the ending of a plural: -ies becomes -y, and -es and -s lose their s, but for -eies, -aies, -aes, -ees, -oes, -us and -ss."""
    return (
        F.when(F.length(word) < 4, word)
        .when(word.rlike("[^ea]ies$"), F.regexp_replace(word, "ies$", "y"))
        .when(word.rlike("[^aeo]es$"), F.regexp_replace(word, "s$", ""))
        .when(word.rlike("[^us]s$") & ~word.rlike("es$"), F.regexp_replace(word, "s$", ""))
        .otherwise(word)
    )


#: The endings of Russian words, by the published suffix-stripping rules. A group with a lookbehind needs а or я before it.
_AFTER_A = "(?<=[ая])"
_GERUND = f"({_AFTER_A}(в|вши|вшись)|(ив|ивши|ившись|ыв|ывши|ывшись))$"
_REFLEXIVE = "(ся|сь)$"
_ADJECTIVE = "(ее|ие|ые|ое|ими|ыми|ей|ий|ый|ой|ем|им|ым|ом|его|ого|ему|ому|их|ых|ую|юю|ая|яя|ою|ею)$"
_PARTICIPLE = f"({_AFTER_A}(ем|нн|вш|ющ|щ)|(ивш|ывш|ующ))$"
_VERB = f"({_AFTER_A}(ла|на|ете|йте|ли|й|л|ем|н|ло|но|ет|ют|ны|ть|ешь|нно)|(ила|ыла|ена|ейте|уйте|ите|или|ыли|ей|уй|ил|ыл|им|ым|ен|ило|ыло|ено|ят|ует|уют|ит|ыт|ены|ить|ыть|ишь|ую|ю))$"
_NOUN = "(а|ев|ов|ие|ье|е|иями|ями|ами|еи|ии|и|ией|ей|ой|ий|й|иям|ям|ием|ем|ам|ом|о|у|ах|иях|ях|ы|ь|ию|ью|ю|ия|ья|я)$"
_DERIVED = "(ост|ость)$"
_SUPERLATIVE = "(ейш|ейше)$"
_VOWEL = "[аеиоуыэюя]"


def russian_stem(word: str) -> str:
    """A Russian word without its inflection; one without a Russian vowel stays as it is."""
    word = word.replace("ё", "е")
    head, vowel, rest = re.match(f"([^аеиоуыэюя]*)({_VOWEL}?)(.*)", word, re.DOTALL).groups()
    if not vowel:
        return word
    cut = lambda x, ending: re.sub(ending, "", x, count=1)
    first = cut(rest, _GERUND)
    if first == rest:
        plain = cut(rest, _REFLEXIVE)
        adjective, verb = cut(plain, _ADJECTIVE), cut(plain, _VERB)
        first = cut(adjective, _PARTICIPLE) if adjective != plain else verb if verb != plain else cut(plain, _NOUN)
    second = cut(first, "и$")
    # a derivational ending goes only where it begins after the second syllable of the rest
    region = re.match(f".*?[^аеиоуыэюя].*?{_VOWEL}[^аеиоуыэюя](.*)$", second)
    third = cut(second, _DERIVED) if region and re.search(_DERIVED, region[1]) else second
    superlative = cut(third, _SUPERLATIVE)
    if third.endswith("нн"):
        last = third[:-1]
    elif superlative != third:
        last = re.sub("нн$", "н", superlative)
    else:
        last = cut(third, "ь$")
    return head + vowel + last


@F.arrow_udf(StringType())
def russian_stems(found: pa.Array) -> pa.Array:
    """Stems of words; each distinct word of a batch is worked out once."""
    coded = found.dictionary_encode()
    known = pa.array([None if w is None else russian_stem(w) for w in coded.dictionary.to_pylist()], pa.string())
    return known.take(coded.indices)


def stem(word: Column) -> Column:
    """Russian words without their inflection, others without the ending of a plural."""
    # other words don't go to Python
    return F.coalesce(russian_stems(F.when(word.rlike("[а-яё]"), word)), plural_stem(word))


def postings(docs: DataFrame, key: str = "doc_id", text: str = "text", stemmer: Stemmer = stem) -> DataFrame:
    """The index of docs as shards of about SHARD_WORDS words of whole documents: (shard, term, n, words, docs, lengths, counts, positions).

    A row per shard and term lists the n documents that have it by id, each with its number of words, how often it has the term, and where; counts
    cut positions. The row of the empty term has the shard's number of texts and of words. Documents without words are in none. Texts meet by id in one task,
    which goes through their words as a stream, so that a word is in no shuffle.
    """
    own = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).filter("doc_id is not null and text is not null").repartition("doc_id")
    # the length is taken before words are exploded, so that no row carries them all
    counted = own.select("doc_id", words(F.col("text")).alias("words")).select("doc_id", F.size("words").alias("doc_length"), "words").filter("doc_length > 0")
    each = counted.sortWithinPartitions("doc_id", "doc_length").select("doc_id", "doc_length", F.posexplode("words").alias("position", "word"))
    rows = each.select(F.spark_partition_id().alias("part"), "doc_id", "doc_length", "position", stemmer(F.col("word")).alias("term"))
    kind = own.schema["doc_id"].dataType.simpleString()
    names = ["shard", "term", "n", "words", "docs", "lengths", "counts", "positions"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, shard = [], 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if size >= SHARD_WORDS:
                # a shard ends where another document begins
                same = pc.equal(batch.column(1), held[-1].column(1)[-1]).to_numpy(zero_copy_only=False)
                cut = batch.num_rows if same.all() else int(same.argmin())
                held.append(batch.slice(0, cut))
                batch = batch.slice(cut)
                if batch.num_rows:
                    yield packed(held, shard)
                    held, size, shard = [], 0, shard + 1
            if batch.num_rows:
                held.append(batch)
                size += batch.num_rows
        if held:
            yield packed(held, shard)

    def packed(held: list[pa.RecordBatch], shard: int) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        part = table.column(0)[0].as_py()
        ids, terms = (table.column(i).combine_chunks().dictionary_encode() for i in (1, 4))
        doc, length, position = ids.indices.to_numpy(), table.column(2).to_numpy(), table.column(3).to_numpy()
        order = pc.sort_indices(terms.dictionary)
        rank = np.empty(len(order), np.int32)
        rank[order.to_numpy()] = np.arange(len(order))
        code = rank[terms.indices.to_numpy()]
        by = np.argsort(code, kind="stable")  # documents are in order already
        code, doc, length, at = code[by], doc[by], length[by], position[by]
        new_term = np.r_[True, code[1:] != code[:-1]]
        entry = np.flatnonzero(new_term | np.r_[True, (doc[1:] != doc[:-1]) | (length[1:] != length[:-1])])
        first = np.flatnonzero(new_term)
        # row 0 is that of the empty term
        of_entries, of_words = (np.r_[0, x, n].astype(np.int32) for x, n in ((np.searchsorted(entry, first), len(entry)), (first, len(code))))
        listed = lambda offsets, values: pa.ListArray.from_arrays(pa.array(offsets), values)
        columns = [
            pa.array(np.full(len(first) + 1, part << 32 | shard)), pa.concat_arrays([pa.array([""], terms.dictionary.type), terms.dictionary.take(order)]),
            pa.array(np.r_[int((position == 0).sum()), np.diff(of_entries[1:])].astype(np.int64)), pa.array(np.r_[len(code), np.diff(of_words[1:])].astype(np.int64)),
            listed(of_entries, ids.dictionary.take(pa.array(doc[entry]))), listed(of_entries, pa.array(length[entry])), listed(of_entries, pa.array(np.diff(np.r_[entry, len(code)]).astype(np.int32))), listed(of_words, pa.array(at)),
        ]
        return pa.RecordBatch.from_arrays(columns, names=names)

    return rows.mapInArrow(run, f"shard bigint, term string, n bigint, words bigint, docs array<{kind}>, lengths array<int>, counts array<int>, positions array<int>")


def write_index(index: DataFrame, path: str, files: int | None = None) -> None:
    """Postings as their tasks make them, each shard in order of terms; files: how many at most."""
    (index.coalesce(files) if files else index).write.mode("overwrite").parquet(f"{path}/postings")
    index.sparkSession.read.parquet(f"{path}/postings").filter("term = ''").agg(F.sum("n").alias("n_docs"), F.sum("words").alias("n_words")).write.mode("overwrite").parquet(f"{path}/totals")


def read_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/totals")


def literals(queries: DataFrame, stemmer: Stemmer = stem) -> DataFrame:
    """(query_id, alternative, literal, negated, offset, size, term) of queries (query_id, query): a phrase has a row per word, a word one."""
    pieces = F.regexp_extract_all("query", F.lit(r'-?"[^"]*"|\S+'), F.lit(0))
    each = queries.select("query_id", F.posexplode(pieces).alias("literal", "piece"))
    # the number of alternatives that have ended before
    ended = F.sum((F.lower("piece") == "or").cast("int")).over(Window.partitionBy("query_id").orderBy("literal"))
    shaped = each.withColumn("alternative", ended).filter(F.lower("piece") != "or").withColumn("negated", F.startswith("piece", F.lit("-")) & (F.length("piece") > 1))
    spoken = shaped.withColumn("words", words(F.col("piece"))).filter(F.size("words") > 0)
    each = spoken.select("query_id", "alternative", "literal", "negated", F.size("words").alias("size"), F.posexplode("words").alias("offset", "word"))
    return each.withColumn("term", stemmer(F.col("word"))).drop("word")


def bm25(queries: DataFrame, index: DataFrame, totals: DataFrame, k: int, stemmer: Stemmer = stem) -> DataFrame:
    """(query_id, doc_id, score, rank): the k best matches of each of queries (query_id, query); ties go by doc_id.

    The queries' literals are counted first; more than MOST_LITERALS are searched in parts by query, so what goes to the tasks stays bounded.
    """
    asked = checkpoint(literals(queries, stemmer))
    parts = max(1, -(-asked.count() // MOST_LITERALS))
    found = []
    for p in range(parts):
        own = asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == p).toArrow()  # about MOST_LITERALS rows
        found.append(_best(queries.sparkSession.createDataFrame(own, asked.schema), own, index, totals, k))
    return reduce(DataFrame.unionByName, found)


@dataclass
class Asked:
    """A query: its place among the queries, its alternatives (literals that must occur and that must not, each the terms of its words), and what it is scored by."""

    place: int
    alternatives: list[tuple[list[tuple[str, ...]], list[tuple[str, ...]]]]
    terms: list[str]


def arranged(wanted: pa.Table) -> tuple[pa.Array, list[Asked]]:
    """The ids of the queries of literals, and the queries; an alternative without anything that must occur is left out."""
    ids = wanted.column("query_id").combine_chunks().dictionary_encode()
    found: dict[tuple, dict[int, str]] = {}
    rest = zip(ids.indices.to_pylist(), *(wanted.column(c).to_pylist() for c in ("alternative", "literal", "negated", "offset", "term")))
    for place, alternative, literal, negated, offset, term in rest:
        found.setdefault((place, alternative, literal, negated), {})[offset] = term
    queries: dict[int, dict[int, tuple[list, list]]] = {}
    for (place, alternative, _, negated), by_offset in sorted(found.items(), key=lambda x: x[0]):
        queries.setdefault(place, {}).setdefault(alternative, ([], []))[negated].append(tuple(by_offset[i] for i in sorted(by_offset)))
    out = []
    for place, alternatives in queries.items():
        scored = sorted({t for must, _ in alternatives.values() for terms in must for t in terms})
        out.append(Asked(place, [(must, barred) for must, barred in alternatives.values() if must], scored))
    return ids.dictionary, [q for q in out if q.alternatives]


class Shard:
    """The postings of some terms in one shard, (term, weight, docs, lengths, counts, positions) with the mean length of all documents."""

    def __init__(self, rows: pa.Table, mean: float, longest: int):
        value = lambda name: pc.list_flatten(rows.column(name).combine_chunks())
        ids = value("docs").dictionary_encode()
        order = pc.sort_indices(ids.dictionary)
        rank = np.empty(len(order), np.int64)
        rank[order.to_numpy()] = np.arange(len(order))
        self.ids, self.docs = ids.dictionary.take(order), rank[ids.indices.to_numpy()]
        counts, lengths, positions = (value(c).to_numpy(zero_copy_only=False) for c in ("counts", "lengths", "positions"))
        sizes, spans = (np.r_[0, np.cumsum(pc.list_value_length(rows.column(c)).to_numpy())] for c in ("docs", "positions"))
        weight = np.repeat(rows.column("weight").to_numpy(), np.diff(sizes))
        self.parts = weight * counts * (K1 + 1) / (counts + K1 * (1 - B + B * lengths / mean))
        # a place for each position, with room between documents for the longest phrase
        self.stride = int(lengths.max(initial=0)) + longest + 1
        # only terms of phrases have positions
        placed = np.repeat(np.diff(spans) > 0, np.diff(sizes))
        term = np.repeat(np.arange(len(sizes) - 1), np.diff(spans))
        self.places = np.repeat(self.docs[placed], counts[placed]) * self.stride + positions
        # copies of one id have places of their own twice
        by = np.lexsort((self.places, term))
        self.places = self.places[by]
        self.at = {t: (a, b, c, d) for t, a, b, c, d in zip(rows.column("term").to_pylist(), sizes.tolist(), sizes[1:].tolist(), spans.tolist(), spans[1:].tolist())}

    def having(self, terms: tuple[str, ...]) -> np.ndarray:
        """Which documents have a literal."""
        out = np.zeros(len(self.ids), bool)
        if any(t not in self.at for t in terms):
            return out
        if len(terms) == 1:
            a, b, _, _ = self.at[terms[0]]
            out[self.docs[a:b]] = True
            return out
        # starts of the rarest word, and of those the ones where all others are at their places
        own = sorted((self.at[t][3] - self.at[t][2], i, t) for i, t in enumerate(terms))
        starts = None
        for _, i, t in own:
            places = self.places[self.at[t][2] : self.at[t][3]]
            if starts is None:
                starts = places - i
            else:
                near = np.searchsorted(places, starts + i)
                starts = starts[places[np.minimum(near, len(places) - 1)] == starts + i]
            if not len(starts):
                return out
        out[(starts + own[0][1]) // self.stride] = True
        return out

    def best(self, query: Asked, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best matches, as numbers of documents, and their scores; ties go by id."""
        matched = np.zeros(len(self.ids), bool)
        for must, barred in query.alternatives:
            if any(t not in self.at for terms in must for t in terms):
                continue
            own = self.having(must[0])
            for terms in must[1:]:
                own &= self.having(terms)
            for terms in barred:
                own &= ~self.having(terms)
            matched |= own
        found = np.flatnonzero(matched)
        if not len(found):
            return found, np.zeros(0)
        scores = np.zeros(len(self.ids))
        for t in query.terms:
            if t in self.at:
                a, b, _, _ = self.at[t]
                scores += np.bincount(self.docs[a:b], self.parts[a:b], len(scores))
        order = np.lexsort((found, -np.round(scores[found], 9)))[:k]
        return found[order], scores[found[order]]


def _best(wanted: DataFrame, literal_rows: pa.Table, index: DataFrame, totals: DataFrame, k: int) -> DataFrame:
    """The k best matches of the queries of some literals: each shard's, and of those the best of all. The postings of their terms meet by shard; a match is in no shuffle."""
    ids, queries = arranged(literal_rows)
    longest = max([len(terms) for q in queries for alternative in q.alternatives for own in alternative for terms in own], default=1)
    # one row per term of the queries, and one of totals
    terms = F.broadcast(wanted.groupBy("term").agg(F.max(F.col("size") > 1).alias("in_phrase")))
    frequency = index.select("term", "n").join(terms.select("term"), "term").groupBy("term").agg(F.sum("n").alias("df"))
    weight = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = frequency.crossJoin(F.broadcast(totals)).select("term", weight.alias("weight"), (F.col("n_words") / F.col("n_docs")).alias("mean"))
    positions = F.when(F.col("in_phrase"), F.col("positions")).otherwise(F.array().cast("array<int>")).alias("positions")
    asked = index.join(terms, "term").join(F.broadcast(weights), "term").select("shard", "mean", "term", "weight", "docs", "lengths", "counts", positions)
    rows = asked.repartition("shard").sortWithinPartitions("shard")
    schema = f"query_id {wanted.schema['query_id'].dataType.simpleString()}, doc_id {index.schema['docs'].dataType.elementType.simpleString()}, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            shards = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(shards[1:] != shards[:-1]) + 1).tolist(), batch.num_rows] if batch.num_rows else [0]
            for a, b in zip(cuts, cuts[1:]):
                if held and held[0].column(0)[0].as_py() != shards[a]:
                    yield searched(held)
                    held = []
                held.append(batch.slice(a, b - a))
        if held:
            yield searched(held)

    def searched(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        shard = Shard(pa.Table.from_batches(held), held[0].column(1)[0].as_py(), longest)
        found = [(q.place, *shard.best(q, k)) for q in queries]
        places = np.repeat(np.array([f[0] for f in found], np.int64), np.array([len(f[1]) for f in found], np.int64))
        docs, scores = (np.concatenate([np.zeros(0, kind), *(f[i] for f in found)]) for i, kind in ((1, np.int64), (2, np.float64)))
        return pa.RecordBatch.from_arrays([ids.take(pa.array(places)), shard.ids.take(pa.array(docs)), pa.array(scores, pa.float64())], names=["query_id", "doc_id", "score"])

    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "doc_id")
    return rows.mapInArrow(run, schema).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
