"""Token counts of texts under a unigram model, by dynamic programming that shared prefixes share.

A pre-token is a word (between the six ASCII blanks) after the mark for a word's start. ``vocabulary`` has each different
pre-token of the corpus once, with its occurrences. ``terminal_counts`` deals them out in ranges, sorted, so that a task
walks the trie of its range: a pre-token keeps the forward scores of the prefix it shares with the one before and
computes only the rest. The terminal count, the number of tokens on the best path, is stored for each pre-token, once for
the whole corpus; a text's count is the sum over its words. Words with more than one in ``shared`` occurrences of the
corpus, of which there are at most ``shared``, and of ``short`` bytes at most, are looked up in a broadcast table; all
other words meet their terminal counts by a join.

A path's score is the sum of its pieces' scores; of equal scores the path with fewer tokens wins. A character may also be
spelled by its UTF-8 bytes, one token each, at a score below all pieces. Pieces come from a sentencepiece file whose path
is a parameter; it is of fixed size (below 1 MB), read on the driver and broadcast. The scores of a BPE file are ranks of
merges, which do not add up: ``fit`` counts the file's pieces in all pre-tokens of a corpus as the file's own encoder cuts
them, and gives the logarithms of their shares. Every piece is kept; one never met counts as half an occurrence. Texts are
not normalised before.

Defined cases: null, empty and blank texts have no tokens; a very long text is read whole, and a very long word is a
pre-token like others; every row is counted, so repeated rows repeat their counts; an empty table gives none; further
columns, whatever their names, are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.llm.common import raw, store

START = "▁"


def encoder(path: str):
    """The file's encoder, and the numbers of its pieces that are neither marks nor bytes."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return model, [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]


class Unigram:
    """scores: by piece, from ``fit``; the file's own ones, if it is of a unigram model."""

    def __init__(self, path: str, scores: dict[str, float] | None = None):
        model, normal = encoder(path)
        self.score = {p: model.get_score(i) if scores is None else scores[p] for i in normal for p in [model.id_to_piece(i)]}
        self.longest = max(map(len, self.score))
        self.byte_score = min(self.score.values()) - 10.0

    def counts(self, words: list[str]) -> dict[str, int]:
        """The number of tokens of each word; words must be sorted and different."""
        score, longest, byte_score = self.score, self.longest, self.byte_score
        best, tokens = [0.0], [0]  # forward scores and counts of the current path through the trie
        last, out = "", {}
        for word in words:
            shared, most = 0, min(len(last), len(word))
            while shared < most and last[shared] == word[shared]:
                shared += 1
            del best[shared + 1 :], tokens[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                spelled = len(word[end - 1].encode())
                top, n = best[end - 1] + spelled * byte_score, tokens[end - 1] + spelled
                for begin in range(max(0, end - longest), end):
                    s = score.get(word[begin:end])
                    if s is not None:
                        s += best[begin]
                        if s > top or s == top and tokens[begin] + 1 < n:
                            top, n = s, tokens[begin] + 1
                best.append(top)
                tokens.append(n)
            out[word] = tokens[-1]
            last = word
        return out


def vocabulary(docs: DataFrame) -> DataFrame:
    """pretoken, n: the corpus's pre-tokens with their numbers of occurrences, counted before and after one shuffle."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = Counter(w for t in raw(batch.column(0)) if t for w in t.split())
            yield pa.record_batch([pa.array([START + w.decode("utf-8", "replace") for w in n], pa.string()), pa.array(n.values(), pa.int64())], names=["pretoken", "n"])

    return docs.select("text").mapInArrow(rows, "pretoken string, n long").groupBy("pretoken").agg(F.sum("n").alias("n"))


def fit(words: DataFrame, path: str) -> dict[str, float]:
    """Log probabilities of all pieces, from a vocabulary. Each different pre-token is encoded once; the counts are whole
    numbers, so equal corpora give equal scores. The result is as large as the list of pieces."""
    model, normal = encoder(path)
    content = words.sparkSession.sparkContext.broadcast(model.serialized_model_proto())

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        cut, n = sentencepiece.SentencePieceProcessor(model_proto=content.value), Counter()
        for batch in batches:
            own = [w[len(START) :] for w in batch.column(0).to_pylist()]
            for pieces, k in zip(cut.encode(own), batch.column(1).to_pylist(), strict=True):
                for i in pieces:
                    n[i] += k
        yield pa.record_batch([pa.array(n.keys(), pa.int32()), pa.array(n.values(), pa.int64())], names=["piece", "n"])

    met = words.select("pretoken", "n").mapInArrow(rows, "piece int, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    n = {r.piece: r.n for r in met.collect()}  # at most a row for each piece
    weight = {i: n.get(i, 0) or 0.5 for i in normal}
    whole = math.log(sum(weight.values()))
    return {model.id_to_piece(i): math.log(w) - whole for i, w in weight.items()}


def terminal_counts(words: DataFrame, path: str, scores: dict[str, float] | None = None) -> DataFrame:
    """pretoken, n, n_tokens: the walk through the trie of all pre-tokens of a vocabulary."""
    model = words.sparkSession.sparkContext.broadcast(Unigram(path, scores))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:  # sorted, so that a batch is a stretch of the trie
            own = batch.column(0).to_pylist()
            found = model.value.counts(own)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array([found[w] for w in own], pa.int64())], names=["pretoken", "n", "n_tokens"])

    return words.select("pretoken", "n").repartitionByRange("pretoken").sortWithinPartitions("pretoken").mapInArrow(rows, "pretoken string, n long, n_tokens long")


def token_counts(docs: DataFrame, path: str, fitted: bool = True, shared: int = 1 << 21, short: int = 32) -> DataFrame:
    """doc_id, n_pretokens, n_tokens: a row for each document. fitted: with log probabilities counted over docs, else with
    the file's own scores."""
    words = store(vocabulary(docs), "vocabulary")
    known = store(terminal_counts(words, path, fit(words, path) if fitted else None), "terminal-counts")
    total = known.agg(F.sum("n")).first()[0] or 0
    common = known.where((F.col("n") * shared > total) & (F.octet_length("pretoken") <= short))  # at most `shared` rows
    table = docs.sparkSession.sparkContext.broadcast({r.pretoken[len(START) :].encode(): r.n_tokens for r in common.select("pretoken", "n_tokens").collect()})

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = table.value.get
        for batch in batches:
            n_pretokens, n_tokens, others = [], [], []
            for text in raw(batch.column(2)):
                w = text.split() if text else []
                n = list(map(get, w))
                rare = [x for x, k in zip(w, n) if k is None] if None in n else []
                n_pretokens.append(len(w))
                n_tokens.append(sum(filter(None, n)))
                others.append([START + x.decode("utf-8", "replace") for x in rare])
            arrays = [batch.column(0), batch.column(1), pa.array(n_pretokens, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array(others, pa.list_(pa.string()))]
            yield pa.record_batch(arrays, names=["row", "doc_id", "n_pretokens", "n_common", "others"])

    schema = "row long, doc_id long, n_pretokens long, n_common long, others array<string>"
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    counted = store(numbered.mapInArrow(rows, schema), "counted")  # row is fixed from here on
    rare = counted.select("row", F.explode("others").alias("pretoken")).join(known.select("pretoken", "n_tokens"), "pretoken")
    rare = rare.groupBy("row").agg(F.sum("n_tokens").alias("n_rare"))
    both = counted.drop("others").join(rare, "row", "left")
    return both.select("doc_id", "n_pretokens", (F.col("n_common") + F.coalesce("n_rare", F.lit(0))).alias("n_tokens"))
