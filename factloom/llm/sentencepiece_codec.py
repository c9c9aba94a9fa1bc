"""Operator 10, SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a single-pass Viterbi.

At every position the automaton's state gives the longest piece that ends there, and its output links all shorter ones;
each relaxes the best score of that position. The result is the segmentation with the greatest sum of piece scores (the
unigram rule; of equal sums the one with the longer last piece). A character without a piece of its own is spelled in byte
pieces. Words are lanes: since no piece has a word mark behind another character, words are independent, and the distinct
words of a batch advance together, a byte at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import binaries, column, flat, lists, map_arrow, project
from .hashing import Rolling

MARK, SPACE = "▁", 0x20
#: Words that are done byte by byte once no more are left: long ones, without blanks.
FEW = 8
UNKNOWN_PENALTY = 10.0
_roll = Rolling(61)


class Codec:
    """Encoder and decoder of one model file (identity normalisation, dummy prefix, byte fallback)."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        if sp.normalize("a  b\né") != f"{MARK}a{MARK}{MARK}b\né":
            raise NotImplementedError("only models with identity normalisation and a dummy prefix are supported")
        n = sp.get_piece_size()
        self.size = n
        self.byte_id = np.full(256, -1, np.int32)
        pieces: list[tuple[bytes, int, float]] = []
        text = [b""] * n
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_id[value] = i
                text[i] = bytes([value])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                raw = piece.replace(MARK, " ").encode()
                pieces.append((raw, i, sp.get_score(i)))
                text[i] = raw
        if (self.byte_id < 0).any():
            raise NotImplementedError("only models with byte fallback are supported")
        #: No piece has a word mark behind another character: then texts split into words.
        self.by_word = all(b" " not in raw.lstrip(b" ") for raw, _, _ in pieces)
        self.unknown = min(s for _, _, s in pieces) - UNKNOWN_PENALTY
        self.bytes = np.frombuffer(b"".join(text), np.uint8)
        self.starts = np.concatenate([[0], np.cumsum([len(t) for t in text])])
        self._automaton(pieces)

    def _automaton(self, pieces: list[tuple[bytes, int, float]]) -> None:
        used = np.zeros(256, bool)
        for raw, _, _ in pieces:
            used[np.frombuffer(raw, np.uint8)] = True
        self.symbol = np.where(used, np.cumsum(used), 0).astype(np.int64)  # 0: bytes of no piece
        width = int(used.sum()) + 1
        children: list[dict[int, int]] = [{}]
        end: dict[int, tuple[int, int, float]] = {}
        symbol = self.symbol.tolist()
        for raw, i, score in pieces:
            state = 0
            for b in raw:
                state = children[state].setdefault(symbol[b], len(children))
                if state == len(children):
                    children.append({})
            end[state] = (i, len(raw), score)
        n = len(children)
        move, fail = np.zeros((n, width), np.int32), np.zeros(n, np.int64)
        self.piece, self.length, self.score = np.full(n, -1, np.int32), np.zeros(n, np.int64), np.zeros(n)
        for state, (i, length, score) in end.items():
            self.piece[state], self.length[state], self.score[state] = i, length, score
        first, link = np.zeros(n, np.int64), np.zeros(n, np.int64)  # longest piece that ends at a state; the next shorter one
        level = np.zeros(1, np.int64)
        while len(level):  # breadth first: states of one depth at a time
            parent = np.array([p for p in level for _ in children[p]], np.int64)
            sym = np.array([s for p in level for s in children[p]], np.int64)
            child = np.array([c for p in level for c in children[p].values()], np.int64)
            if level[0]:
                move[level] = move[fail[level]]
                link[level] = first[fail[level]]
                first[level] = np.where(self.piece[level] >= 0, level, link[level])
                fail[child] = move[fail[parent], sym]
            move[parent, sym] = child
            level = child
        self.move, self.first, self.link = move, first, link

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (bytes and offsets), and where each text's begin."""
        data, offsets = self._prefixed(data, offsets)
        n = len(data)
        if not n:
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        begin = np.zeros(n, bool)
        begin[offsets[:-1][np.diff(offsets) > 0]] = True
        if self.by_word:
            space = data == SPACE
            begin[1:] |= space[1:] & ~space[:-1]
        starts = np.flatnonzero(begin)
        ends = np.append(starts[1:], n)
        hashes = _roll.of(_roll.sums(data), starts, ends)
        _, pick, which = np.unique(hashes, return_index=True, return_inverse=True)
        ids, bounds = self._lanes(data, starts[pick], ends[pick])
        counts = np.diff(bounds)[which]
        out_bounds = np.concatenate([[0], np.cumsum(counts)])
        ids = ids[np.repeat(bounds[:-1][which] - out_bounds[:-1], counts) + np.arange(out_bounds[-1])]
        doc_bounds = out_bounds[np.searchsorted(starts, offsets)]
        if not np.array_equal(self._spelled(ids)[0], data):  # two words with one hash: encode again, each by itself
            ids, out_bounds = self._lanes(data, starts, ends)
            doc_bounds = out_bounds[np.searchsorted(starts, offsets)]
        return ids, doc_bounds

    def _prefixed(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A space before every text that is not empty; word marks in a text count as spaces."""
        mark = np.frombuffer(MARK.encode(), np.uint8)
        at = np.flatnonzero((data[:-2] == mark[0]) & (data[1:-1] == mark[1]) & (data[2:] == mark[2])) if len(data) > 2 else np.zeros(0, np.int64)
        if len(at):
            keep = np.ones(len(data), bool)
            keep[at + 1] = keep[at + 2] = False
            data = data.copy()
            data[at] = SPACE
            kept = np.concatenate([[0], np.cumsum(keep)])
            data, offsets = data[keep], kept[offsets]
        full = np.diff(offsets) > 0
        out = np.insert(data, offsets[:-1][full], SPACE)
        return out, offsets + np.concatenate([[0], np.cumsum(full)])

    def _lanes(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Viterbi over many words at once: (ids, where each word's begin)."""
        sizes = ends - starts
        order = np.argsort(-sizes, kind="stable")
        size, start = sizes[order], starts[order]
        base = np.concatenate([[0], np.cumsum(size + 1)])[:-1]  # a word's positions 0..size
        total = int((size + 1).sum())
        best = np.full(total, -np.inf)
        best[base] = 0
        back, chosen = np.zeros(total, np.int64), np.full(total, -2, np.int64)  # bytes of the last piece, its id (-1: unknown)
        inner = (data & 0xC0) == 0x80
        symbols = self.symbol[data]
        state, width = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
        active = len(size)
        for t in range(1, int(size[0]) + 1 if len(size) else 1):
            while size[active - 1] < t:
                active = int(np.searchsorted(-size, -t, "right"))
            if active <= FEW:  # a step of arrays costs more than that many bytes one by one
                for k in range(active):
                    a = slice(base[k], base[k] + size[k] + 1)
                    self._one(symbols[start[k] : start[k] + size[k]], inner[start[k] : start[k] + size[k]], t, int(state[k]), int(width[k]), best[a], back[a], chosen[a])
                break
            at = start[:active] + t - 1
            state[:active] = s = self.move[state[:active], symbols[at]]
            width[:active] = w = np.where(inner[at], width[:active] + 1, 1)  # bytes of the character so far
            here = base[:active] + t
            top, length, piece = np.full(active, -np.inf), np.zeros(active, np.int64), np.full(active, -2, np.int64)
            single = np.zeros(active, bool)
            node = self.first[s]
            lanes = np.flatnonzero(node)
            node = node[lanes]
            while len(lanes):  # along the output links
                n = self.length[node]
                value = best[here[lanes] - n] + self.score[node]
                single[lanes] |= n == w[lanes]
                better = value > top[lanes]
                win = lanes[better]
                top[win], length[win], piece[win] = value[better], n[better], self.piece[node[better]]
                node = self.link[node]
                on = np.flatnonzero(node)
                lanes, node = lanes[on], node[on]
            done = (t == size[:active]) | ~inner[np.minimum(at + 1, len(data) - 1)]  # a character ends here
            spell = np.flatnonzero(done & ~single)
            value = best[here[spell] - w[spell]] + self.unknown
            better = value > top[spell]
            win = spell[better]
            top[win], length[win], piece[win] = value[better], w[win], -1
            best[here], back[here], chosen[here] = top, length, piece
        # Walk back; each piece is noted at its last byte, and an unknown character at each of its bytes.
        token = np.full(total, -1, np.int64)
        lane, pos = np.arange(len(size)), size.copy()
        while len(lane):
            if len(lane) <= FEW:
                for k, p in zip(lane.tolist(), pos.tolist(), strict=True):
                    a, first = int(base[k]), int(start[k])
                    ids, steps = chosen[a : a + p + 1].tolist(), back[a : a + p + 1].tolist()
                    while p > 0:
                        if ids[p] >= 0:
                            token[a + p] = ids[p]
                        else:
                            token[a + p - steps[p] + 1 : a + p + 1] = self.byte_id[data[first + p - steps[p] : first + p]]
                        p -= steps[p]
                break
            at = base[lane] + pos
            ids, n = chosen[at], back[at]
            known = ids >= 0
            token[at[known]] = ids[known]
            for k in range(int(n[~known].max(initial=0))):
                some = np.flatnonzero(~known & (n > k))
                token[at[some] - k] = self.byte_id[data[start[lane[some]] + pos[some] - 1 - k]]
            pos = pos - n
            on = np.flatnonzero(pos > 0)
            lane, pos = lane[on], pos[on]
        counts = np.add.reduceat((token >= 0).astype(np.int64), base) if total else np.zeros(0, np.int64)
        # Back to the order of the words given.
        own = np.concatenate([[0], np.cumsum(counts)])
        ids = token[token >= 0].astype(np.int32)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        bounds = np.concatenate([[0], np.cumsum(counts[rank])])
        return ids[np.repeat(own[:-1][rank] - bounds[:-1], counts[rank]) + np.arange(bounds[-1])], bounds

    def _one(self, symbols: np.ndarray, inner: np.ndarray, t: int, state: int, width: int, best: np.ndarray, back: np.ndarray, chosen: np.ndarray) -> None:
        """The rest of one word from its byte ``t`` on, as in ``_lanes``; best, back and chosen are the word's own, and are filled."""
        move, first, link, length, score, piece = self.move, self.first, self.link, self.length, self.score, self.piece
        top, steps, ids = best[:t].tolist(), [], []
        after, last = inner.tolist(), len(inner)
        for at, symbol in enumerate(symbols[t - 1 :].tolist(), t):
            state = int(move[state, symbol])
            width = width + 1 if after[at - 1] else 1
            most, step, chose, single = -np.inf, 0, -2, False
            node = int(first[state])
            while node:  # along the output links
                n = int(length[node])
                single |= n == width
                value = top[at - n] + float(score[node])
                if value > most:
                    most, step, chose = value, n, int(piece[node])
                node = int(link[node])
            if not single and (at == last or not after[at]) and top[at - width] + self.unknown > most:
                most, step, chose = top[at - width] + self.unknown, width, -1
            top.append(most)
            steps.append(step)
            ids.append(chose)
        best[t:], back[t:], chosen[t:] = top[t:], steps, ids

    def _spelled(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.diff(self.starts)[ids]
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        return self.bytes[np.repeat(self.starts[:-1][ids] - bounds[:-1], sizes) + np.arange(bounds[-1])], bounds

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all texts (without the prefix), and where each begins. Ids outside the model are an error."""
        if len(ids) and (ids.min() < 0 or ids.max() >= self.size):
            raise ValueError("an id is not of this model")
        data, each = self._spelled(ids)
        offsets = each[bounds]
        drop = offsets[:-1][(np.diff(offsets) > 0)]
        drop = drop[data[drop] == SPACE]
        gone = np.zeros(len(data) + 1, np.int64)
        gone[drop + 1] = 1
        return np.delete(data, drop), offsets - np.cumsum(gone)[offsets]


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, ids (array<int>).

    Null and empty texts have no ids. A word mark (U+2581) in a text is read as a space. Texts of any length; rows may
    repeat and ids be null. Empty table: no rows. Other columns are ignored.
    """
    rows = project(docs, doc_id=id_col, text=text_col)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, bounds = codec(model).encode(*flat(column(batch, "text")))
        return pa.RecordBatch.from_arrays([column(batch, "doc_id"), lists(ids, bounds)], ["doc_id", "ids"])

    return map_arrow(rows, run, f"doc_id {dict(rows.dtypes)['doc_id']}, ids array<int>")


def decode(tokens: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per row of ``tokens``: doc_id, text. Null ids give null, no ids an empty text; bytes that are no UTF-8 (ids not
    made by ``encode``) become replacement characters."""
    rows = project(tokens, doc_id=id_col, ids=ids_col)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = column(batch, "ids")
        filled = pc.fill_null(ids, pa.scalar([], ids.type))
        data, offsets = codec(model).decode(*_values(filled))
        raw = binaries(data.tobytes(), offsets)
        try:
            text = raw.cast(pa.string())
        except pa.ArrowInvalid:
            text = pa.array([x.decode(errors="replace") for x in raw.to_pylist()], pa.string())
        return pa.RecordBatch.from_arrays([column(batch, "doc_id"), pc.if_else(ids.is_valid(), text, pa.scalar(None, pa.string()))], ["doc_id", "text"])

    return map_arrow(rows, run, f"doc_id {dict(rows.dtypes)['doc_id']}, text string", text=None)


def _values(ids: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.asarray(ids.offsets).astype(np.int64)
    return np.asarray(ids.values)[offsets[0] : offsets[-1]].astype(np.int64), offsets - offsets[0]


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_ids, ids_crc32 (little-endian unsigned 32-bit), n_bytes and sha256 of the text decoded from the ids, and
    whether it equals the text. Encoding and decoding run in one pass, so that ids need no shuffle and no second scan."""
    import zlib

    docs = project(spark.read.parquet(f"{sf_dir}/documents.parquet"), doc_id="doc_id", text="text")
    model = model_path()

    def digest(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = flat(column(batch, "text"))
        ids, bounds = codec(model).encode(data, offsets)
        back, ends = codec(model).decode(ids.astype(np.int64), bounds)
        packed = ids.astype("<u4").tobytes()
        crc = [zlib.crc32(packed[4 * s : 4 * e]) for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(np.diff(bounds)), pa.array(crc, pa.int64()), binaries(back.tobytes(), ends), column(batch, "text")], ["doc_id", "n_ids", "ids_crc32", "decoded", "text"])

    out = map_arrow(docs, digest, f"doc_id {dict(docs.dtypes)['doc_id']}, n_ids long, ids_crc32 long, decoded binary, text string")
    original = F.coalesce("text", F.lit("")).cast("binary")
    return out.select("doc_id", "n_ids", "ids_crc32", F.octet_length("decoded").cast("long").alias("n_bytes"), F.sha2("decoded", 256).alias("decoded_sha256"), (F.col("decoded") == original).alias("round_trip"))
