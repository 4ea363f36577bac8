"""Encoding and decoding with a merge-type SentencePiece vocabulary.

A normalised text starts as single characters. An agenda holds its adjacent
pairs whose union is a piece, ordered by the piece's score, then place; the
best pair is joined, its neighbours enter the agenda anew, until it is empty.
Symbols that are no pieces become byte pieces.

Two characters that stand side by side in no piece are never joined, so a text
is cut between them first (here: before each run of word marks) and equal cuts
share a result. The agendas of many short cuts advance together as rows of a
numpy matrix, one join each a round; a long cut has a heap of its own.

Every Arrow batch is checked against the sentencepiece library, and a difference
fails the job: the library encodes each cut that the worker has not met before,
and decodes the ids of every text. ``whole=True`` makes it encode every whole
text as well, which costs more than this module's own work.

Special input: a null text counts as empty and gives the begin and end ids only;
a text of any length is encoded whole (a worker holds one batch, which is cut
into blocks of ``BLOCK_BYTES``, and at most ``CACHE`` cuts); repeated rows get
equal results; an empty table gives no rows; other columns pass through.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from itertools import chain, pairwise

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from kpiforge.llm.common import blocks, segment_sums, table

MARK = "▁"
#: Cuts whose ids a worker remembers, and the longest one that is remembered or joined in a matrix.
CACHE, SHORT = 500_000, 32
#: Rows of a matrix of agendas.
ROWS = 1 << 16
NEVER = np.iinfo(np.int32).max

RESULT = "ids binary, decoded string"


class Pieces:
    """A vocabulary: ranks of pieces by score, pairs that make a piece, bytes of each id."""

    def __init__(self, model: str):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=model)
        count = sp.vocab_size()
        names = [sp.id_to_piece(i) for i in range(count)]
        plain = [i for i in range(count) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        order = {s: k for k, s in enumerate(sorted({sp.get_score(i) for i in plain}, reverse=True))}
        self.id_of = {names[i]: i for i in plain}
        self.rank_of = {names[i]: order[sp.get_score(i)] for i in plain}
        self.byte_id = {int(names[i][3:-1], 16): i for i in range(count) if sp.is_byte(i)}
        self.unknown = sp.unk_id()
        self.begin, self.end = sp.bos_id(), sp.eos_id()
        self.byte_of = np.full(count, -1, np.int64)
        for b, i in self.byte_id.items():
            self.byte_of[i] = b
        self.text_of = [b"" if sp.is_control(i) else bytes([self.byte_of[i]]) if sp.is_byte(i)
                        else " ⁇ ".encode() if sp.is_unknown(i) else names[i].replace(MARK, " ").encode()
                        for i in range(count)]
        self.marked = [names[i].startswith(MARK) for i in range(count)]
        self.cuttable = not any(MARK in p.lstrip(MARK) for p in self.id_of)
        self._pairs()
        self.fronted = sp.normalize("a").startswith(MARK)     # normalising puts a word mark before a text
        self.cache: dict[str, bytes] = {}

    def _pairs(self) -> None:
        """Sorted keys left id << 32 | right id of all pairs that make a piece, with its id and rank."""
        found = [(self.id_of[p[:k]] << 32 | self.id_of[p[k:]], i, self.rank_of[p])
                 for p, i in self.id_of.items() for k in range(1, len(p)) if p[:k] in self.id_of and p[k:] in self.id_of]
        found.sort()
        self.pair, self.made, self.pair_rank = (np.array([f[j] for f in found], t) for j, t in
                                                enumerate((np.int64, np.int32, np.int32)))
        # a matrix holds ids, so only characters that are pieces enter; no other character may be part of a piece
        self.char_id = np.full(0x110000, -1, np.int32)
        for p, i in self.id_of.items():
            if len(p) == 1:
                self.char_id[ord(p)] = i
        self.closed = all(self.char_id[ord(c)] >= 0 for p in self.id_of for c in p) and len(self.pair) > 0
        for b, i in self.byte_id.items():                      # such a character ends as one byte piece and joins nothing
            if b < 0x80 and self.char_id[b] < 0:
                self.char_id[b] = i

    def joined(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, id) of the piece that each pair makes; NEVER where there is none."""
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        hit = (self.pair[at] == key) & (left >= 0) & (right >= 0)
        return np.where(hit, self.pair_rank[at], NEVER), self.made[at]

    def by_matrix(self, cuts: list[str]) -> list[bytes]:
        """Ids of short cuts of known characters: one agenda a row, all advance together."""
        size = np.array([len(c) for c in cuts])
        chars = self.char_id[np.frombuffer("".join(cuts).encode("utf-32-le"), np.uint32)]
        width = int(size.max()) + 1
        inside = np.arange(width) < size[:, None]
        sym = np.full((len(cuts), width), -1, np.int32)
        sym[inside] = chars
        after = np.tile(np.arange(1, width + 1), (len(cuts), 1))
        before = np.tile(np.arange(-1, width - 1), (len(cuts), 1))
        rank = np.full((len(cuts), width), NEVER, np.int32)
        made = np.zeros((len(cuts), width), np.int32)
        rank[:, :-1], made[:, :-1] = self.joined(sym[:, :-1], sym[:, 1:])
        rows = np.arange(len(cuts))
        while len(rows):
            best = rank[rows].argmin(axis=1)                 # the leftmost of equal ranks
            go = rank[rows, best] != NEVER
            rows, i = rows[go], best[go]
            if not len(rows):
                break
            j = after[rows, i]
            k, h = after[rows, j], before[rows, i]
            sym[rows, i] = made[rows, i]
            sym[rows, j] = -1
            rank[rows, j] = NEVER
            after[rows, i] = k
            in_row = k < width
            before[rows[in_row], k[in_row]] = i[in_row]
            right = np.where(in_row, sym[rows, np.minimum(k, width - 1)], -1)
            rank[rows, i], made[rows, i] = self.joined(sym[rows, i], right)
            led = h >= 0
            r, a, b = rows[led], h[led], i[led]
            rank[r, a], made[r, a] = self.joined(sym[r, a], sym[r, b])
        left = sym >= 0
        raw = sym[left].astype("<u4").tobytes()
        ends = np.cumsum(left.sum(axis=1) * 4).tolist()
        return [raw[a:b] for a, b in zip([0, *ends], ends)]

    def by_heap(self, cut: str) -> bytes:
        """Ids of any cut: a heap of (rank, place) over a linked list of symbols."""
        sym: list[str | None] = list(cut)
        after, before = list(range(1, len(sym) + 1)), list(range(-1, len(sym) - 1))
        rank_of = self.rank_of
        agenda = [(rank_of[a + b], i, len(a) + len(b)) for i, (a, b) in enumerate(pairwise(cut)) if a + b in rank_of]
        heapq.heapify(agenda)
        while agenda:
            _, i, size = heapq.heappop(agenda)
            j = after[i]
            if sym[i] is None or j >= len(sym) or len(sym[i]) + len(sym[j]) != size:
                continue                                       # one of the pair was joined meanwhile
            sym[i] += sym[j]
            sym[j] = None
            k = after[i] = after[j]
            if k < len(sym):
                before[k] = i
            for a, b in ((before[i], i), (i, k)):
                if a >= 0 and b < len(sym) and sym[a] + sym[b] in rank_of:
                    heapq.heappush(agenda, (rank_of[sym[a] + sym[b]], a, len(sym[a]) + len(sym[b])))
        out: list[int] = []
        lost = False                                           # unknown symbols side by side are one
        for s in sym:
            if s is None:
                continue
            i = self.id_of.get(s)
            if i is None and self.byte_id:
                out += [self.byte_id[b] for b in s.encode("utf-8", "replace")]
            elif i is not None or not lost:
                out.append(self.unknown if i is None else i)
            lost = i is None and not self.byte_id
        return np.array(out, "<u4").tobytes()

    def learn(self, cuts: set[str]) -> dict[str, bytes]:
        """Ids of cuts that are not remembered."""
        new: dict[str, bytes] = {}
        every = list(cuts)
        size = np.fromiter(map(len, every), np.int64, len(every))
        order = np.argsort(size, kind="stable")
        order = order[:np.searchsorted(size[order], SHORT, "right")] if self.closed else order[:0]
        short, size = [every[i] for i in order.tolist()], size[order]      # rows of about one width meet in a matrix
        flags = self.char_id[np.frombuffer("".join(short).encode("utf-32-le"), np.uint32)] >= 0
        known = segment_sums(flags, np.cumsum(size)) == size
        fit = [short[i] for i in np.flatnonzero(known).tolist()]
        for a in range(0, len(fit), ROWS):
            new.update(zip(fit[a:a + ROWS], self.by_matrix(fit[a:a + ROWS])))
        for c in cuts:
            if c not in new:
                new[c] = self.by_heap(c)
        self.confirm(new)
        return new

    def confirm(self, new: dict[str, bytes]) -> None:
        """Compare the ids of cuts with the library's, which puts the first word mark in front itself."""
        known = [c for c in new if self.fronted and c.startswith(MARK) and c != MARK]
        for a in range(0, len(known), ROWS):
            part = known[a:a + ROWS]
            said = self.library.encode([c[1:] for c in part], num_threads=1)
            raw = np.fromiter(chain.from_iterable(said), "<u4").tobytes()
            if raw != b"".join(map(new.__getitem__, part)):
                wrong = next(c for c, i in zip(part, said) if np.array(i, "<u4").tobytes() != new[c])
                raise ValueError(f"differs from the sentencepiece library: {wrong[:200]!r}")

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text with the begin and the end id, as little-endian 32-bit integers."""
        plain = [self.library.normalize(t) for t in texts]
        cut = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+").findall if self.cuttable else (lambda t: [t] if t else [])
        parts = [cut(t) for t in plain]
        if len(self.cache) > CACHE:
            self.cache.clear()
        new = self.learn(set().union(*parts) - self.cache.keys())
        self.cache |= new
        first, last = (np.array([i], "<u4").tobytes() if i >= 0 else b"" for i in (self.begin, self.end))
        out = [first + b"".join(map(self.cache.__getitem__, p)) + last for p in parts]
        for c in new:
            if len(c) > SHORT:
                del self.cache[c]
        return out

    def decode(self, ids: bytes) -> str:
        """The text of ids: word marks become spaces, the one that normalising put in front goes, byte pieces join."""
        at = np.frombuffer(ids, "<u4")
        pieces = [self.text_of[i] for i in at.tolist()]
        lead = next((k for k, p in enumerate(pieces) if p), None)
        if lead is not None and self.fronted and self.marked[at[lead]]:
            pieces[lead] = pieces[lead][1:]
        if b"" not in pieces[1:-1]:                            # else a control id may part bytes
            try:
                return b"".join(pieces).decode()
            except UnicodeDecodeError:
                pass                                           # bytes that are no text: one mark for each such byte
        out, run = [], b""
        for p, b in zip(pieces, self.byte_of[at].tolist()):
            if b >= 0:
                run += p
                continue
            out += [run.decode("utf-8", "surrogateescape"), p.decode()]
            run = b""
        out.append(run.decode("utf-8", "surrogateescape"))
        return re.sub("[\ud800-\udfff]", "�", "".join(out))


_loaded: dict[str, Pieces] = {}


def pieces(model: str) -> Pieces:
    if model not in _loaded:
        _loaded.clear()
        _loaded[model] = Pieces(model)
    return _loaded[model]


def encoded(text: Column, model: str, whole: bool = False) -> Column:
    """Struct column of RESULT: ids as little-endian 32-bit integers, and the text that they decode to."""

    @pandas_udf(RESULT)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = pieces(model)
        for s in batches:
            texts = s.fillna("").tolist()
            rows: list[tuple[bytes, str]] = []
            for a, b in blocks(texts):
                ids = own.encode(texts[a:b])
                back = [own.decode(i) for i in ids]
                if back != own.library.decode([np.frombuffer(i, "<u4").tolist() for i in ids], num_threads=1):
                    raise ValueError("decodes otherwise than the sentencepiece library")
                if whole and ids != [np.array(own.library.encode(t, add_bos=own.begin >= 0, add_eos=own.end >= 0), "<u4").tobytes()
                                     for t in texts[a:b]]:
                    raise ValueError("encodes otherwise than the sentencepiece library")
                rows += zip(ids, back)
            yield pd.DataFrame(rows, columns=["ids", "decoded"])

    return run(text)


def piece_encoding(docs: DataFrame, model: str, text: str = "text", out: str = "pieces", whole: bool = False) -> DataFrame:
    """Add struct ``out`` of RESULT for ``text``, encoded with the vocabulary at ``model`` (a path on every executor)."""
    return docs.withColumn(out, encoded(F.col(f"`{text}`"), model, whole))


def op12_sentencepiece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    p = piece_encoding(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))
    return p.select("doc_id", (F.octet_length("pieces.ids") / 4).cast("long").alias("n_tokens"),
                    F.sha2("pieces.ids", 256).alias("ids_sha256"),
                    F.sha2(F.encode("pieces.decoded", "UTF-8"), 256).alias("decoded_sha256"))
