"""SentencePiece encoding and decoding as a relational lattice.

The text (spaces as U+2581, one put in front) is cut into *units* at every
place whose two neighbouring characters no piece holds side by side: no piece
can cross such a place, so units are encoded on their own, and each distinct
unit once:

1. all units are counted (partial counts in the scan);
2. a unit's substrings of at most ``max piece length`` characters are exploded
   and equi-joined with the (broadcast, fixed) piece table: the edges of its
   lattice;
3. edges are grouped by unit and folded by a Viterbi pass written with Spark's
   higher-order ``aggregate``: for each end position, the best path's last
   piece; then the path is read backwards.

A byte-pair model does not rank paths by a sum of scores.  Its result is the
one path on which no two neighbouring pieces p, q would have been merged across
their border: a merge of a suffix s of p with a prefix t of q happens if the
piece ``st`` ranks before the merge that takes s further inside p and not after
the one that takes t further inside q.  These limits are columns of the piece
table, one per suffix and prefix length, and ``st`` is itself an edge of the
lattice, so the fold decides admissibility from the lattice alone and finds
exactly the ids of the sentencepiece library.

The dictionary (unit -> ids) goes to the tasks by broadcast.  It holds the most
frequent units, at most ``MAX_UNITS`` of at most ``UNIT_CHARS`` characters; a
unit outside of it is merged in the task by the model's own rule, with the same
result.  Characters of no piece become their UTF-8 bytes' pieces.

Defined results: null text counts as empty; an empty text has no ids and
decodes to the empty text; U+2581 in a text decodes to a space, as in the
library; repeated rows and null ids are encoded each; other columns pass
through ``encode_documents`` unless they have the name of an added column, which
is replaced.  Texts of any length are encoded whole; of equally ranked merges the
leftmost goes first; an empty table gives an empty one.
"""

from __future__ import annotations

import heapq
import operator
import re
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lurescope.llm.common import Remembered, most_frequent, ship, stage

SPACE = "▁"
MAX_UNITS = 100_000
UNIT_CHARS = 40
#: Chunks counted before they are emitted, and bytes of chunks that an encoder
#: remembers in each generation.
_REMEMBER, _CHUNK_BYTES = 200_000, 32 << 20
_FOREVER = 2**31 - 1


def default_model() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


@dataclass
class PieceTable:
    """Pieces, ranks and byte pieces of a model."""
    rank: dict[str, tuple[int, int]]            # piece -> (rank, id)
    byte_id: list[int]
    text_of: list[bytes]                        # id -> decoded bytes
    pairs: set[str] = field(default_factory=set)     # neighbours in some piece

    @classmethod
    def load(cls, path: str) -> PieceTable:
        import sentencepiece
        m = sentencepiece.SentencePieceProcessor(model_file=path)
        rank, byte_id, text_of = {}, [0] * 256, []
        normal = []
        for i in range(m.get_piece_size()):
            p = m.id_to_piece(i)
            if m.is_byte(i):
                byte_id[int(p[3:5], 16)] = i
                text_of.append(bytes([int(p[3:5], 16)]))
            elif m.is_control(i) or m.is_unknown(i) or m.is_unused(i):
                text_of.append(b"")
            else:
                normal.append((-m.get_score(i), i, p))
                text_of.append(p.replace(SPACE, " ").encode())
        # equal scores are one rank: then the leftmost merge goes first
        last, r = None, -1
        for score, i, p in sorted(normal):
            r += score != last
            last = score
            rank[p] = (r, i)
        t = cls(rank, byte_id, text_of)
        t.pairs = {p[i:i + 2] for p in rank for i in range(len(p) - 1)}
        if any(SPACE in p.lstrip(SPACE) for p in rank):
            raise ValueError("a piece of this model holds a space behind a character")
        return t

    def merge(self, text: str) -> tuple[list[str], list]:
        """The model's merges on one text: (symbols, merge trees).  Of all
        neighbours that make a piece, the best-ranked merge, leftmost first."""
        sym, tree = list(text), list(text)
        if len(sym) > 64:
            return self._merge_long(text)
        get = self.rank.get
        none = (_FOREVER, 0)
        ranks = [get(a + b, none)[0] for a, b in zip(sym, sym[1:])]
        while ranks:
            r = min(ranks)
            if r == _FOREVER:
                break
            i = ranks.index(r)
            made = sym[i] + sym[i + 1]
            sym[i:i + 2] = [made]
            tree[i:i + 2] = [(r, tree[i], tree[i + 1], made)]
            del ranks[i]
            if i:
                ranks[i - 1] = get(sym[i - 1] + made, none)[0]
            if i < len(ranks):
                ranks[i] = get(made + sym[i + 1], none)[0]
        return sym, tree

    def _merge_long(self, text: str) -> tuple[list[str], list]:
        """The same with a heap of candidate merges, for long texts."""
        sym, n = list(text), len(text)
        tree: list = list(text)
        prev, nxt = list(range(-1, n - 1)), list(range(1, n + 1))
        heap: list = []

        def push(a: int, b: int) -> None:
            if a >= 0 and b < n and (got := self.rank.get(sym[a] + sym[b])):
                heapq.heappush(heap, (got[0], a, b, sym[a] + sym[b]))

        for i in range(n - 1):
            push(i, i + 1)
        while heap:
            r, a, b, made = heapq.heappop(heap)
            if not sym[a] or nxt[a] != b or sym[a] + sym[b] != made or not sym[b]:
                continue
            sym[a], sym[b] = made, ""
            tree[a] = (r, tree[a], tree[b], made)
            nxt[a] = nxt[b]
            if nxt[b] < n:
                prev[nxt[b]] = a
            push(prev[a], a)
            push(a, nxt[a])
        keep = [i for i in range(n) if sym[i]]
        return [sym[i] for i in keep], [tree[i] for i in keep]

    def symbols(self, text: str) -> list[str]:
        """``merge`` without the trees."""
        sym = list(text)
        if len(sym) > 64:
            return self._merge_long(text)[0]
        get, none = self.rank.get, (_FOREVER, 0)
        ranks = [get(a + b, none)[0] for a, b in zip(sym, sym[1:])]
        while ranks and (r := min(ranks)) != _FOREVER:
            i = ranks.index(r)
            sym[i] = made = sym[i] + sym.pop(i + 1)
            del ranks[i]
            if i:
                ranks[i - 1] = get(sym[i - 1] + made, none)[0]
            if i < len(ranks):
                ranks[i] = get(made + sym[i + 1], none)[0]
        return sym

    def ids(self, unit: str) -> list[int]:
        out = []
        for s in self.symbols(unit):
            got = self.rank.get(s)
            out.extend([got[1]] if got else [self.byte_id[b] for b in s.encode()])
        return out

    def rows(self) -> list[tuple]:
        """(piece, id, rank, valid, right limits, left limits): the limit at n
        is the rank of the merge that takes the suffix (prefix) of n characters
        further, -1 where that suffix is no symbol on the way to the piece."""
        out = []
        for p, (r, i) in self.rank.items():
            symbols, trees = self.merge(p)
            right, left = [-1] * (len(p) + 1), [-1] * (len(p) + 1)
            if len(symbols) == 1:
                for limits, side in ((right, 2), (left, 1)):
                    node, until = trees[0], _FOREVER
                    while True:
                        limits[len(node if isinstance(node, str) else node[3])] = until
                        if isinstance(node, str):
                            break
                        until, node = node[0], node[side]
            out.append((p, i, r, len(symbols) == 1, right, left))
        return out

    def units(self, text: str) -> list[str]:
        """The text cut wherever no piece holds the two neighbours side by side."""
        out, start, pairs = [], 0, self.pairs
        if pairs.issuperset(map(operator.add, text, text[1:])):
            return [text]
        for i in range(1, len(text)):
            if text[i - 1:i + 1] not in pairs:
                out.append(text[start:i])
                start = i
        out.append(text[start:])
        return out


_CHUNK = re.compile(r" +[^ ]*")


def chunks(text: str) -> list[str]:
    """A text's parts, each the run of spaces before a word and the word, without
    the first space (one space is put in front of the text).  Pieces hold spaces
    at their start or nowhere, so no piece crosses the border of two parts."""
    if not text:
        return []
    if "  " not in text and text[0] != " " and text[-1] != " ":
        return text.split(" ")
    return [m[1:] for m in _CHUNK.findall(" " + text)]


def _texts(column: pa.Array) -> list[str]:
    return column.fill_null("").to_pylist()


def _count_units(table: PieceTable):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def flush():
            units: Counter = Counter()
            for chunk, c in held.items():
                for u in table.units(SPACE + chunk.replace(" ", SPACE)):
                    if len(u) <= UNIT_CHARS:
                        units[u] += c
            return pa.RecordBatch.from_arrays(
                [pa.array(list(units), pa.string()), pa.array(list(units.values()), pa.int64())],
                names=["unit", "c"])

        for batch in batches:
            for text in _texts(batch.column("text")):
                held.update(chunks(text))
                if len(held) >= _REMEMBER:
                    yield flush()
                    held.clear()
        yield flush()
    return run


def lattice_paths(units: DataFrame, table: PieceTable) -> DataFrame:
    """(unit, path): the ids along the admissible path, -1 for a character of
    no piece."""
    spark = units.sparkSession
    longest = max(map(len, table.rank), default=1)
    pieces = F.broadcast(spark.createDataFrame(
        table.rows(), "piece string, id int, r int, valid boolean, rl array<int>, ll array<int>"))
    # a fixed number of tasks: the rows are few and short, the folds are not
    tasks = max(2 * spark.sparkContext.defaultParallelism,
                int(spark.conf.get("spark.sql.shuffle.partitions")))
    sub = (units.repartition(tasks, "unit").withColumn("n", F.char_length("unit"))
           .withColumn("x", F.explode(F.expr(f"""
                flatten(transform(sequence(0, n - 1), i -> transform(
                    sequence(1, least({longest}, n - i)),
                    m -> named_struct('i', i, 'm', m, 's', substring(unit, i + 1, m)))))"""))))
    edges = (sub.join(pieces, F.col("x.s") == F.col("piece"), "left")
             .filter("piece IS NOT NULL OR x.m = 1")
             .select("unit", "n", F.expr(f"""named_struct(
                'k', x.i + x.m, 'i', x.i, 'id', coalesce(id, -1), 'r', coalesce(r, {_FOREVER}),
                'valid', coalesce(valid, true), 'rl', coalesce(rl, array(-1, {_FOREVER})),
                'll', coalesce(ll, array(-1, {_FOREVER})))""").alias("e")))
    grouped = edges.groupBy("unit", "n").agg(F.array_sort(F.collect_list("e")).alias("edges"))
    # pieces that lie across each place
    grouped = grouped.withColumn("across", F.expr("""
        transform(sequence(0, n), y -> transform(filter(edges, m -> m.i < y AND m.k > y),
            m -> named_struct('i', m.i, 'k', m.k, 'r', m.r)))"""))
    last = F.expr("""
        aggregate(filter(edges, e -> e.valid),
            cast(array() AS array<struct<i:int,id:int,rl:array<int>>>),
            (acc, e) -> CASE
                WHEN e.k <> size(acc) + 1 THEN acc
                WHEN e.i > 0 AND exists(across[e.i], m -> m.i >= acc[e.i - 1].i AND m.k <= e.k
                        AND m.r < acc[e.i - 1].rl[e.i - m.i] AND m.r <= e.ll[m.k - e.i]) THEN acc
                ELSE array_append(acc, named_struct('i', e.i, 'id', e.id, 'rl', e.rl)) END)""")
    path = F.expr("""
        aggregate(sequence(1, n), named_struct('at', n, 'ids', cast(array() AS array<int>)),
            (acc, s) -> CASE WHEN acc.at <= 0 THEN acc ELSE named_struct(
                'at', last[acc.at - 1].i, 'ids', concat(array(last[acc.at - 1].id), acc.ids)) END,
            acc -> acc.ids)""")
    return grouped.withColumn("last", last).select("unit", path.alias("path"))


def _dictionary(broadcast) -> dict[str, bytes]:
    """The broadcast dictionary as unit -> ids; it lives as long as its task."""
    units, lens, flat = broadcast.value
    flat = flat.astype("<i4").tobytes()
    ends = np.cumsum(lens) * 4
    return {u: flat[e - 4 * n:e] for u, n, e in
            zip(units.split("\x00"), lens.tolist(), ends.tolist())} if len(lens) else {}


def _pack(rows: pd.DataFrame, table: PieceTable) -> tuple[str, np.ndarray, np.ndarray]:
    units, ids = [], []
    for u, path in zip(rows["unit"], rows["path"]):
        if "\x00" in u:
            continue
        path = list(path)
        if -1 in path:                       # such a unit is one character
            path = [x for i in path for x in
                    ([i] if i >= 0 else [table.byte_id[b] for b in u.encode()])]
        units.append(u)
        ids.append(path)
    lens = np.array([len(x) for x in ids], np.int64)
    return "\x00".join(units), lens, np.array([i for x in ids for i in x], np.int32)


def _chunk_ids(table: PieceTable, known: dict[str, bytes], lossy: list[str], chunk: str) -> bytes:
    """Serialized ids of a chunk; it is added to ``lossy`` if they do not decode to it."""
    out = []
    for u in table.units(SPACE + chunk.replace(" ", SPACE)):
        got = known.get(u)
        out.append(array("i", table.ids(u)).tobytes() if got is None else got)
    got = b"".join(out)
    if decode(table, array("i", got)) != chunk.replace(SPACE, " "):
        lossy.append(chunk)
    return got


class _Encoder:
    """Ids of texts from the dictionary, remembering the chunks, and with each whether its
    ids decode to it: a text decodes to the decoded chunks in a row."""

    def __init__(self, table: PieceTable, known: dict[str, bytes]):
        self.lossy: list[str] = []
        # not a method: an encoder in a cycle would outlive its task
        self.chunks = Remembered(partial(_chunk_ids, table, known, self.lossy), _CHUNK_BYTES)

    def encode(self, text: str) -> tuple[bytes, bool]:
        got = b"".join(map(self.chunks.__getitem__, chunks(text)))
        if not self.lossy:
            return got, True
        for chunk in self.lossy:                # forgotten, so that the next text finds them again
            self.chunks.pop(chunk, None)
            self.chunks.old.pop(chunk, None)
        self.lossy.clear()
        return got, False


_ROWS = 1_000


def _encode(table: PieceTable, broadcast, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _Encoder(table, _dictionary(broadcast))
        for whole in batches:
            for a in range(0, len(whole), _ROWS):
                batch = whole.slice(a, _ROWS)
                flat, lens, same = [], [], []
                for text in _texts(batch.column(text_col)):
                    b, whole_again = encoder.encode(text)
                    flat.append(b)
                    lens.append(len(b) // 4)
                    same.append(whole_again)
                offs = pa.array(np.concatenate([[0], np.cumsum(lens)]).astype(np.int32))
                values = pa.array(np.frombuffer(b"".join(flat), "<i4"))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(lens, pa.int64()),
                     pa.ListArray.from_arrays(offs, values), pa.array(same, pa.bool_())],
                    names=[*batch.schema.names, "n_tokens", "ids", "round_trip"])
    return run


def decode(table: PieceTable, ids: list[int]) -> str:
    """The text of an id sequence: pieces joined, the first space taken off."""
    parts = table.text_of
    text = b"".join([parts[i] for i in ids]).decode("utf-8", "replace")
    return text[1:] if text.startswith(" ") else text


def decode_ids(df: DataFrame, ids_col="ids", out_col="decoded", model: str | None = None) -> DataFrame:
    """``df`` with the text of its id column (null ids: null)."""
    ship(df.sparkSession)
    table = PieceTable.load(model or default_model())

    def run(batches):
        for batch in batches:
            texts = [None if x is None else decode(table, x)
                     for x in batch.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())],
                                             names=[*batch.schema.names, out_col])
    df = df.drop(out_col)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields]
    return df.mapInArrow(run, ", ".join([*fields, f"{out_col} string"]))


def encode_documents(docs: DataFrame, text_col="text", model: str | None = None,
                     max_units: int = MAX_UNITS) -> DataFrame:
    """``docs`` with ``n_tokens``, ``ids`` and ``round_trip`` (the ids decode to
    the text)."""
    spark = docs.sparkSession
    ship(spark)
    table = PieceTable.load(model or default_model())
    counts = (docs.select(F.col(text_col).cast("string").alias("text"))
              .mapInArrow(_count_units(table), "unit string, c bigint")
              .groupBy("unit").agg(F.sum("c").alias("c")))
    counts = stage(counts, "piece-units")
    paths = stage(lattice_paths(most_frequent(counts, "c", max_units).select("unit"), table), "piece-paths")
    packed = _pack(paths.toPandas(), table)       # at most max_units short rows
    broadcast = spark.sparkContext.broadcast(packed)
    docs = docs.drop("n_tokens", "ids", "round_trip").withColumn(
        text_col, F.col(text_col).cast("string"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields]
    return docs.mapInArrow(
        _encode(table, broadcast, text_col),
        ", ".join([*fields, "n_tokens bigint", "ids array<int>", "round_trip boolean"]))
