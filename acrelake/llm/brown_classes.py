"""Language-model scores by Brown classes: words in classes by distributed exchange, class transitions times word emissions.

Texts are read and tokenised once, into pieces: about PIECE tokens of whole documents with a word list of their own. Counts of all
words come from the pieces' lists, and go back to them by one join per distinct word of a piece, not per token; what remains of a piece
is a code for each token.

The EXCHANGED most frequent words of up to LONGEST bytes take part in the rounds, which bounds the class map that every task gets. Until
these end, all other words are classed by the order of magnitude of their count. Then each of these, too, moves to the class that raises the
likelihood most, by all of its neighbours in training texts: their counts meet by a shuffle on the word, and their classes go back to the pieces by
a join. Words that no class suits better, and words not seen in training, stay in the classes of magnitude. No count
is left out: classes and transitions are estimated from every training token.

Each round gathers, for every exchanged word, how often each class stands before and after it, adds these up by word, and moves words to
the class that raises the likelihood of class bigrams most. Words are dealt out to WORKERS tasks that move theirs one after the
other against their own copy of the class matrix, as in distributed exchange clustering. The classes of the best round stay.

With c(w) + 1 as a word's weight, its emission is its share of its class, and transitions are smoothed towards the classes' shares:
P(w | w') = P(w) * T(class | class') / P(class), P(w) being the unigram estimate. Over the vocabulary and one unknown word it sums to one.

Defined results: a null text is empty and has the end alone; a null id reads as the empty string where training texts are chosen;
repeated rows count and come as often as they are there; without training texts every word is unknown; extra columns are dropped; an empty
table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acrelake.llm.common import drop_written, release_shuffles, written, written_in_turns

#: Tokens of a piece; one document may exceed it.
PIECE = 1 << 20
#: Bytes of distinct words after which a piece ends too.
PIECE_BYTES = 8 << 20
#: Words meet pieces in so many turns, so that the words of one turn alone are on disk.
TURNS = 2
#: Words that take part in the exchange, bytes of the longest of them, and their classes.
EXCHANGED = 16_384
LONGEST = 64
CLASSES = 64
#: Classes of all other words: the binary orders of magnitude of counts.
BANDS = 48
ALL = CLASSES + BANDS
#: Codes of exchanged words, of bands, and of classes, which other words have once they are placed. Numbers from here on are places in a
#: piece's own list of other words.
CODES = EXCHANGED + BANDS + CLASSES
ROUNDS = 4
WORKERS = 8
#: What a move must gain, in nats, where neighbours are few: to name one of so many classes takes as much.
PRICE = float(np.log(CLASSES))
#: Tokens that the smoothing of transitions weighs.
SMOOTH = 10.0
#: Words whose classes are looked for at once, as 64 numbers go with each of their counts.
AT_ONCE = 500
#: A count beside a word: which class, after the word or, ALL further on, before it, and how often. Packed, as Spark takes bytes along as they
#: are and builds lists of structs value by value.
CELL = np.dtype([("k", "u1"), ("n", "<i8")])
#: The share of documents held out, by the remainder of a checksum of the id.
FOLDS, HELD = 7, 2


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD


class _Numbers(dict):
    """Numbers words as they come."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def pieces_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (piece, ids, held, lens, seq, words, seen): seq has the places of a piece's tokens in ``words`` as 32-bit numbers, each document
    closed by the end, which is the empty word at place 0; ``seen`` counts a word's places in training texts."""
    rows = docs.select(docs[id_col].alias("id"), held_out(docs[id_col]).alias("held"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    kind = dict(rows.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, serial, id_type = TaskContext.get().partitionId() << 32, 0, None
        numbers, ids, held, seqs, tokens, room = _Numbers({b"": 0}), [], [], [], 0, 0

        def row() -> pa.RecordBatch:
            lens = np.array([len(s) for s in seqs], np.int32)
            seq = np.concatenate(seqs)
            seen = np.bincount(seq[np.repeat(~np.array(held, bool), lens)], minlength=len(numbers))
            one = lambda values, t: pa.array([values], pa.list_(t))
            cols = [pa.array([first + serial]), one(ids, id_type), one(held, pa.bool_()), one(lens, pa.int32()), pa.array([seq.tobytes()], pa.binary()), one(list(numbers), pa.binary()), one(seen, pa.int64())]
            return pa.RecordBatch.from_arrays(cols, ["piece", "ids", "held", "lens", "seq", "words", "seen"])

        for batch in batches:
            id_type = batch.column(0).type
            for doc_id, out, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary())):
                words = raw.as_py().lower().split()  # bytes: A-Z and ASCII space alone
                words.append(b"")
                before = len(numbers)
                seq = np.fromiter(map(numbers.__getitem__, words), np.int32, len(words))
                ids.append(doc_id)
                held.append(out)
                seqs.append(seq)
                tokens += len(seq)
                room += sum(map(len, words)) if len(numbers) - before > 1000 else 20 * (len(numbers) - before)
                if tokens >= PIECE or room >= PIECE_BYTES:
                    yield row()
                    serial += 1
                    numbers, ids, held, seqs, tokens, room = _Numbers({b"": 0}), [], [], [], 0, 0
        if ids:
            yield row()

    return rows.mapInArrow(run, f"piece long, ids array<{kind}>, held array<boolean>, lens array<int>, seq binary, words array<binary>, seen array<long>")


def _band(c: Column) -> Column:
    return F.least(F.floor(F.log2(F.greatest(c, F.lit(1)).cast("double"))), F.lit(BANDS - 1)).cast("int")


@dataclass
class Model:
    """Counts of the training texts, the class of each code, and what a class transition adds to a unigram score."""

    n: int
    v: int
    classes: np.ndarray
    gain: np.ndarray
    likelihoods: list[float]
    matrix: np.ndarray
    weight: np.ndarray


def _turns(pieces: DataFrame) -> list[DataFrame]:
    """The rows of ``pieces``, or of a table with a row for each, in TURNS parts."""
    return [pieces.where(F.pmod(F.xxhash64("piece"), F.lit(TURNS)) == turn) for turn in range(TURNS)]


def _coded(pieces: DataFrame, vocabulary: DataFrame, top: DataFrame, n: int, v: int) -> DataFrame:
    """Rows (piece, ids, held, lens, known, base, end, codes, tail, tail_codes): per document the known tokens and the unigram score, per token
    its code; those of training words that aren't exchanged are CODES and the place in the piece's list ``tail``, whose codes are beside it."""
    uses = pieces.select("piece", F.posexplode("words").alias("pos", "word")).join(vocabulary, "word", "left")
    uses = uses.join(F.broadcast(top), "word", "left").select("piece", "pos", F.coalesce("c", F.lit(0)).alias("c"), "code")
    uses = uses.select("piece", F.struct("pos", "c", F.coalesce("code", EXCHANGED + _band(F.col("c"))).alias("code")).alias("use"))
    uses = uses.groupBy("piece").agg(F.collect_list("use").alias("uses"))
    rows = pieces.select("piece", "ids", "held", "lens", "seq", "words").join(uses, "piece")
    kind = dict(rows.dtypes)["ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(len(batch)):
                one = batch.slice(r, 1)
                col = {name: one.column(i) for i, name in enumerate(one.schema.names)}
                use = col["uses"].flatten()
                pos, c, code = (use.field(k).to_numpy(zero_copy_only=False) for k in ("pos", "c", "code"))
                count, codes = np.zeros(len(pos), np.int64), np.zeros(len(pos), np.int32)
                count[pos], codes[pos] = c, code
                own = np.flatnonzero((codes >= EXCHANGED) & (count > 0))
                tail, tail_codes = col["words"].flatten().take(pa.array(own)), codes[own]
                codes[own] = CODES + np.arange(len(own), dtype=np.int32)
                seq = np.frombuffer(col["seq"][0].as_buffer(), np.int32)
                lens = col["lens"].flatten().to_numpy()
                starts = np.concatenate([[0], np.cumsum(lens)[:-1]])
                known = np.add.reduceat((count > 0)[seq].astype(np.int64), starts)
                base = np.add.reduceat(np.log10((count + 1) / (n + v + 1))[seq], starts)
                many = lambda values, t: pa.array([values], pa.list_(t))
                out = [col["piece"], col["ids"], col["held"], col["lens"], many(known, pa.int64()), many(base, pa.float64()), pa.array([int(codes[0])], pa.int32()), pa.array([_packed(codes[seq])], pa.binary()), many(tail, pa.binary()), many(tail_codes, pa.int32())]
                yield pa.RecordBatch.from_arrays(out, ["piece", "ids", "held", "lens", "known", "base", "end", "codes", "tail", "tail_codes"])

    return rows.mapInArrow(run, f"piece long, ids {kind}, held array<boolean>, lens array<int>, known array<long>, base array<double>, end int, codes binary, tail array<binary>, tail_codes array<int>")


def _packed(numbers: np.ndarray) -> bytes:
    """Low halves first, then high ones, which are nearly all alike and take no room."""
    return (numbers & 0xFFFF).astype(np.uint16).tobytes() + (numbers >> 16).astype(np.uint16).tobytes()


def _tokens(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of each piece its row, the numbers of tokens, of those before them, the code of each number and the lengths of documents. Each document
    is closed by the end, so what stands before a document's first token is an end too."""
    at = {name: i for i, name in enumerate(batch.schema.names)}
    for r in range(len(batch)):
        low, high = np.frombuffer(batch.column(at["codes"])[r].as_buffer(), np.uint16).reshape(2, -1).astype(np.int32)
        numbers = low | high << 16
        before = np.concatenate([[batch.column(at["end"])[r].as_py()], numbers[:-1]])
        code = np.concatenate([np.arange(CODES), batch.column(at["tail_codes"]).slice(r, 1).flatten().to_numpy()]).astype(np.int64)
        yield r, numbers, before, code, batch.column(at["lens"]).slice(r, 1).flatten().to_numpy()


def _sequences(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """The same with the codes of the tokens and of those before them."""
    for r, numbers, before, code, lens in _tokens(batch):
        yield r, code[numbers], code[before], lens


def _cells(ends: np.ndarray, k: np.ndarray, n: np.ndarray) -> pa.Array:
    """Counts as one value for each row; ``ends`` are the offsets of the rows."""
    flat = np.empty(len(k), CELL)
    flat["k"], flat["n"] = k, n
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((ends * CELL.itemsize).astype(np.int32)), pa.py_buffer(flat.tobytes())])


def _uncelled(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What :func:`_cells` has packed: of each count its row, its place and its number."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    flat = np.frombuffer(column.buffers()[2], CELL, (ends[-1] - ends[0]) // CELL.itemsize, ends[0]) if ends[-1] > ends[0] else np.zeros(0, CELL)
    return np.repeat(np.arange(len(column)), np.diff(ends) // CELL.itemsize), flat["k"].astype(np.int64), flat["n"].astype(np.int64)


def _gathered(coded: DataFrame, classes: np.ndarray) -> DataFrame:
    """Rows (code, near): how often each class stands after it and before it, in training texts. A task holds one row of 2 * ALL
    numbers for each code, whatever it reads."""
    wide = 2 * ALL

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = np.zeros(CODES * wide, np.int64)
        for batch in batches:
            held = batch.column(batch.schema.names.index("held"))
            for r, codes, before, lens in _sequences(batch):
                learn = np.repeat(~held.slice(r, 1).flatten().to_numpy(zero_copy_only=False), lens)
                codes, before = codes[learn], before[learn]
                near += np.bincount(before * wide + classes[codes], minlength=len(near))
                near += np.bincount(codes * wide + ALL + classes[before], minlength=len(near))
        yield from told(near.reshape(CODES, wide))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = np.zeros(CODES * wide, np.int64)
        for batch in batches:
            row, at, n = _uncelled(batch.column(1))
            np.add.at(near, batch.column(0).to_numpy().astype(np.int64)[row] * wide + at, n)
        yield from told(near.reshape(CODES, wide))

    def told(near: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Only what isn't zero is sent."""
        some = np.flatnonzero(near.any(axis=1))
        for part in np.array_split(some, max(1, len(some) // 2000)) if len(some) else []:
            code, at = np.nonzero(near[part])
            ends = np.concatenate([[0], np.cumsum(np.bincount(code, minlength=len(part)))])
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), _cells(ends, at, near[part[code], at])], ["code", "near"])

    schema = "code int, near binary"
    return coded.select("held", "lens", "end", "codes", "tail_codes").mapInArrow(count, schema).repartition(WORKERS, "code").mapInArrow(add, schema)


def _dense(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    codes, rows = [np.zeros(0, np.int64)], [np.zeros((0, 2 * ALL), np.int64)]
    for batch in batches:
        row, at, n = _uncelled(batch.column(1))
        codes.append(batch.column(0).to_numpy().astype(np.int64))
        rows.append(np.zeros((len(batch), 2 * ALL), np.int64))
        rows[-1][row, at] = n
    return np.concatenate(codes), np.concatenate(rows)


def _matrix(near: DataFrame, classes: np.ndarray) -> np.ndarray:
    """Transitions between classes: at most ALL rows from each of few tasks come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, rows = _dense(batches)
        out = np.zeros((ALL, ALL), np.int64)
        np.add.at(out, classes[codes], rows[:, :ALL])
        some = np.flatnonzero(out.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(list(out[some]), pa.list_(pa.int64()))], ["a", "row"])

    out = np.zeros((ALL, ALL), np.int64)
    for r in near.mapInArrow(run, "a int, row array<long>").collect():
        out[r.a] += np.array(r.row, np.int64)
    return out


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def likelihood(matrix: np.ndarray) -> float:
    """What the log-likelihood of class bigrams has besides the words' own counts."""
    m = matrix.astype(float)
    return float(_xlogx(m).sum() - _xlogx(m.sum(axis=0)).sum() - _xlogx(m.sum(axis=1)).sum())


def exchange(codes: np.ndarray, near: np.ndarray, classes: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """The classes after each of ``codes``, most frequent first, has moved to its best one, the others' context classes held."""
    out = classes.copy()
    after, before = matrix.astype(float), matrix.T.astype(float).copy()
    total = after.sum(axis=1)
    for k in np.argsort(codes, kind="stable"):
        word = codes[k]
        if word >= EXCHANGED:
            continue
        r, left = near[k, :ALL].astype(float), near[k, ALL:].astype(float)
        n, own = r.sum(), out[word]
        after[own] -= r
        before[own] -= left
        total[own] -= n
        gain = np.zeros(CLASSES)
        for sums, x in ((after, r), (before, left)):
            at = np.flatnonzero(x)
            held = np.maximum(sums[:CLASSES, at], 0)
            gain += (_xlogx(held + x[at]) - _xlogx(held)).sum(axis=1)
        gain -= 2 * (_xlogx(total[:CLASSES] + n) - _xlogx(total[:CLASSES]))
        best = int(gain.argmax())
        out[word] = best if gain[best] > gain[own] + 1e-9 else own
        after[out[word]] += r
        before[out[word]] += left
        total[out[word]] += n
    return out


def _moved(near: DataFrame, classes: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, rows = _dense(batches)
        to = exchange(codes, rows, classes, matrix)[codes]
        yield pa.RecordBatch.from_arrays([pa.array(codes.astype(np.int32)), pa.array(to.astype(np.int32))], ["code", "class"])

    out = classes.copy()
    for r in near.mapInArrow(run, "code int, class int").collect():  # a row for each exchanged word
        out[r[0]] = r[1]
    return out


def fit(coded: DataFrame, top: list, weights: np.ndarray, n: int, v: int, rounds: int = ROUNDS) -> Model:
    """``top`` has the exchanged words' rows (word, c); ``weights`` the sums of c + 1 over the words of each band."""
    classes = np.concatenate([np.arange(EXCHANGED) % CLASSES, CLASSES + np.arange(BANDS), np.arange(CLASSES)])
    best, told = None, []
    for turn in range(rounds + 1):
        near = written(_gathered(coded, classes), "near", "zstd")
        matrix = _matrix(near, classes)
        told.append(likelihood(matrix))
        if best is None or told[-1] > best[0]:
            best = told[-1], classes, matrix
        if turn < rounds:
            classes = _moved(near, classes, matrix)
        drop_written(near)
    _, classes, matrix = best
    weight = np.zeros(ALL)
    np.add.at(weight, classes[: len(top)], [r.c + 1 for r in top])
    weight[CLASSES:] += weights
    return Model(n, v, classes, _gain(matrix, weight, n, v), told, matrix, weight)


def _gain(matrix: np.ndarray, weight: np.ndarray, n: int, v: int) -> np.ndarray:
    share = weight / (n + v + 1)
    passed = matrix.astype(float)
    to = (passed + SMOOTH * share) / (passed.sum(axis=1, keepdims=True) + SMOOTH)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(share > 0, np.log10(to / share), 0.0)


def best_class(row: np.ndarray, at: np.ndarray, n: np.ndarray, own: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """The class of each word that isn't exchanged: of CLASSES the one that raises the likelihood most, or its ``own`` band. Its neighbours are
    the entries (row, at, n), at as in :func:`_gathered`."""
    after, before = matrix.astype(float), matrix.T.astype(float)
    sums = np.concatenate([after, before], axis=1)  # by class, then what stands after it and before it
    keys, back = np.unique(row * 2 * ALL + at, return_inverse=True)
    count = np.bincount(back, weights=n, minlength=len(keys))
    row, at = keys // (2 * ALL), keys % (2 * ALL)
    starts = np.searchsorted(row, np.arange(len(own)))
    held, mine = sums[:CLASSES, at].T, sums[own[row], at]
    gain = np.add.reduceat(_xlogx(held + count[:, None]) - _xlogx(sums[:CLASSES])[:, at].T, starts)
    stay = np.add.reduceat(_xlogx(mine) - _xlogx(np.maximum(mine - count, 0)), starts)
    total, of = after.sum(axis=1), np.add.reduceat(np.where(at < ALL, count, 0), starts)
    gain -= 2 * (_xlogx(total[:CLASSES] + of[:, None]) - _xlogx(total[:CLASSES]))
    stay -= 2 * (_xlogx(total[own]) - _xlogx(np.maximum(total[own] - of, 0)))
    gain[:, total[:CLASSES] == 0] = -np.inf  # words move at the same time, and an empty class would get unlike ones
    best = gain.argmax(axis=1)
    return np.where(gain[np.arange(len(own)), best] > stay + PRICE, best, own)


def _placed(coded: DataFrame, model: Model) -> DataFrame:
    """Rows (word, own, c, class): the words that aren't exchanged and move to a class, with their bands and counts."""
    wide, classes, matrix = 2 * ALL, model.classes, model.matrix

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            where = {name: i for i, name in enumerate(batch.schema.names)}
            for r, numbers, before, code, lens in _tokens(batch):
                learn = np.repeat(~batch.column(where["held"]).slice(r, 1).flatten().to_numpy(zero_copy_only=False), lens)
                numbers, before = numbers[learn].astype(np.int64), before[learn].astype(np.int64)
                first, last = before >= CODES, numbers >= CODES
                near = np.concatenate([(before[first] - CODES) * wide + classes[code[numbers[first]]], (numbers[last] - CODES) * wide + ALL + classes[code[before[last]]]])
                keys, n = np.unique(near, return_counts=True)
                word = keys // wide
                some = np.unique(word)
                if not len(some):
                    continue
                ends = np.concatenate([np.searchsorted(word, some), [len(keys)]])
                for i in range(0, len(some), 1 << 20):  # the cells of so many words have offsets of 32 bits
                    part, cut = some[i : i + (1 << 20)], ends[i : i + (1 << 20) + 1]
                    tail = batch.column(where["tail"]).slice(r, 1).flatten().take(pa.array(part))
                    cells = _cells(cut - cut[0], keys[cut[0] : cut[-1]] % wide, n[cut[0] : cut[-1]])
                    yield pa.RecordBatch.from_arrays([tail, pa.array(classes[code[CODES + part]].astype(np.int32)), cells], ["word", "own", "near"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: list[pa.RecordBatch] = []  # rows of the last word, which may go on
        for batch in batches:
            if not len(batch):
                continue
            first = starts_of(batch)
            if len(first) == 1 and left and batch.column(0)[0] == left[0].column(0)[0]:
                left.append(batch)
                continue
            whole = pa.Table.from_batches([*left, batch]).combine_chunks().to_batches()[0]
            first = starts_of(whole)
            for i in range(0, len(first) - 1, AT_ONCE):
                ends = first[i : i + AT_ONCE + 1]
                yield settled(whole.slice(ends[0], ends[-1] - ends[0]), ends[:-1] - ends[0])
            left = [whole.slice(first[-1])]
        if left:
            yield settled(pa.Table.from_batches(left).combine_chunks().to_batches()[0], np.zeros(1, np.int64))

    def starts_of(batch: pa.RecordBatch) -> np.ndarray:
        word = batch.column(0)
        return np.concatenate([[0], 1 + np.flatnonzero(pc.not_equal(word.slice(1), word.slice(0, len(word) - 1)).to_numpy(zero_copy_only=False))])

    def settled(batch: pa.RecordBatch, first: np.ndarray) -> pa.RecordBatch:
        """The words that move; ``first`` are the first rows of each word."""
        row, at, n = _uncelled(batch.column(2))
        row = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(batch))))[row]
        own = batch.column(1).to_numpy().astype(np.int64)[first]
        c = np.bincount(row, weights=np.where(at < ALL, n, 0), minlength=len(first)).astype(np.int64)
        to = best_class(row, at, n, own, matrix)
        move = np.flatnonzero(to != own)
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(first[move])), pa.array(own[move].astype(np.int32)), pa.array(c[move]), pa.array(to[move].astype(np.int32))], ["word", "own", "c", "class"])

    near = coded.select("held", "lens", "end", "codes", "tail", "tail_codes").mapInArrow(count, "word binary, own int, near binary")
    # in the order of words, so that each is met whole; no list of its rows is built
    near = near.repartition("word").sortWithinPartitions("word")
    return near.mapInArrow(place, "word binary, own int, c long, class int")


def _recoded(coded: DataFrame, moved: DataFrame) -> DataFrame:
    """``coded`` with the codes of the words in ``moved`` replaced by those of their classes."""
    uses = coded.select("piece", F.posexplode("tail").alias("pos", "word"))
    uses = uses.join(moved.select("word", "class"), "word").select("piece", F.struct("pos", (EXCHANGED + BANDS + F.col("class")).alias("code")).alias("use"))
    lists = uses.groupBy("piece").agg(F.collect_list("use").alias("uses"))
    rows = coded.join(lists, "piece", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.names.index("tail_codes")
            for r in range(len(batch)):
                one = batch.slice(r, 1)
                use, codes = one.column(at + 1).flatten(), one.column(at).flatten().to_numpy().copy()
                codes[use.field("pos").to_numpy(zero_copy_only=False)] = use.field("code").to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([*one.columns[:at], pa.array([codes], pa.list_(pa.int32()))], batch.schema.names[: at + 1])

    return rows.select(*coded.columns, "uses").mapInArrow(run, coded.schema)


def finished(coded: DataFrame, model: Model) -> tuple[DataFrame, Model]:
    """Words that aren't exchanged move to classes as well, if that raises the likelihood of class bigrams."""
    moved = written(_placed(coded, model), "moved", "zstd")
    release_shuffles(coded.sparkSession)
    sums = moved.groupBy("own", "class").agg(F.sum(F.col("c") + 1).alias("w")).collect()  # at most BANDS * CLASSES
    if not sums:
        return coded, model
    again = written_in_turns([_recoded(some, moved) for some in _turns(coded)], "recoded", "zstd")
    near = written(_gathered(again, model.classes), "near", "zstd")
    matrix = _matrix(near, model.classes)
    drop_written(near, moved)
    told = [*model.likelihoods, likelihood(matrix)]
    if told[-1] <= likelihood(model.matrix):
        drop_written(again)
        return coded, model
    drop_written(coded)
    release_shuffles(coded.sparkSession)
    weight = model.weight.copy()
    for r in sums:
        weight[r["own"]] -= r.w
        weight[r["class"]] += r.w
    return again, Model(model.n, model.v, model.classes, _gain(matrix, weight, model.n, model.v), told, matrix, weight)


def _scores(coded: DataFrame, model: Model, id_col: str) -> DataFrame:
    kind = dict(coded.dtypes)["ids"].removeprefix("array<")[:-1]
    classes, gain = model.classes, model.gain

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = {name: i for i, name in enumerate(batch.schema.names)}
            for r, codes, before, lens in _sequences(batch):
                starts = np.concatenate([[0], np.cumsum(lens)[:-1]])
                flat = {k: batch.column(at[k]).slice(r, 1).flatten() for k in ("ids", "held", "known", "base")}
                score = flat["base"].to_numpy() + np.add.reduceat(gain[classes[before], classes[codes]], starts)
                out = [flat["ids"], flat["held"], pa.array(lens.astype(np.int64)), flat["known"], flat["base"], pa.array(score)]
                yield pa.RecordBatch.from_arrays(out, [id_col, "held_out", "n_tokens", "n_known", "base_score", "score"])

    return coded.mapInArrow(run, f"`{id_col}` {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double")


def class_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """Rows (id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity), one for each row of ``docs``."""
    pieces = written(pieces_of(docs, id_col, text_col), "pieces", "zstd")
    seen = pieces.select(F.explode(F.arrays_zip("words", "seen")).alias("w")).select(F.col("w.words").alias("word"), F.col("w.seen").alias("seen")).where("seen > 0")
    vocabulary = written(seen.groupBy("word").agg(F.sum("seen").alias("c")), "vocabulary", "zstd")
    n, v = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    top = vocabulary.where(F.octet_length("word") <= LONGEST).orderBy(F.col("c").desc(), "word").limit(EXCHANGED).collect()
    known = docs.sparkSession.createDataFrame([(bytes(r.word), i) for i, r in enumerate(top)], "word binary, code int")
    weights = np.zeros(BANDS)
    weights[0] = 1  # the unknown word
    for r in vocabulary.groupBy(_band(F.col("c")).alias("band")).agg(F.sum(F.col("c") + 1).alias("w")).collect():
        weights[r.band] += r.w
    for r in top:
        weights[min(int(r.c).bit_length() - 1, BANDS - 1)] -= r.c + 1
    release_shuffles(docs.sparkSession)
    coded = written_in_turns([_coded(some, vocabulary, known, n, v) for some in _turns(pieces)], "coded", "zstd")
    drop_written(pieces, vocabulary)
    release_shuffles(docs.sparkSession)
    coded, model = finished(coded, fit(coded, top, weights, n, v, rounds))
    out = _scores(coded, model, id_col).withColumn("train_tokens", F.lit(n).cast("long"))
    return out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
