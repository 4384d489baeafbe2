"""A unigram vocabulary, its Viterbi search, and exact tie rules.

The pieces come from a SentencePiece model file.  A file whose scores are
merge ranks (a BPE model) is read as a unigram model whose piece of rank r,
from 0, has the log probability of Zipf's law, -ln(1 + r), in whole
sixteenths.  Whole numbers make sums exact in any order, so that partial
results of a text's chunks combine to what one run over the text gives.

Rules of the library's unigram search, which hold here as well: of paths with
the same score to a position, the one whose last piece starts first wins; a
character that is no piece of its own may stand for itself at the lowest score
less 10, and is written as its UTF-8 bytes.
"""

from __future__ import annotations

import re
from array import array
from dataclasses import dataclass
from math import log

import ahocorasick
import numpy as np

SPACE = "▁"
UNIT = 16
UNKNOWN_PENALTY = 10 * UNIT
NONE = -(1 << 60)
#: Bytes, about, of the segments whose results a worker remembers before it starts afresh, and the longest of them.
MEMORY_BYTES = 96 << 20
REMEMBERED = 64
#: A count and a score in one number, so that a text's are one sum.
SCORE_BITS = 44
_LOW = (1 << SCORE_BITS) - 1


@dataclass
class Vocabulary:
    """Pieces by id, scores in sixteenths (None: never matched), and the ids of the 256 bytes."""

    pieces: list[str]
    scores: list[int | None]
    byte_ids: list[int]
    prefix: bool = True

    @property
    def longest(self) -> int:
        return max(len(p) for p, s in zip(self.pieces, self.scores) if s is not None)

    @staticmethod
    def read(path: str) -> Vocabulary:
        """The vocabulary of a model file, which must keep texts as they are but for a space mark before them."""
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        rules = proto.normalizer_spec
        if not rules.add_dummy_prefix or rules.remove_extra_whitespaces or not rules.escape_whitespaces or rules.precompiled_charsmap or not proto.trainer_spec.byte_fallback:
            raise ValueError("the file's texts are to be kept as they are, with a space mark before them, and unknown characters as bytes")
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        pieces = [model.id_to_piece(i) for i in range(n)]
        normal = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        scores: list[int | None] = [None] * n
        for rank, i in enumerate(sorted(normal, key=lambda i: (-model.get_score(i), i))):
            scores[i] = -round(UNIT * log(1 + rank))
        return Vocabulary(pieces, scores, [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)])


class Memory(dict):
    """What a function gave for the segments seen of late; long ones, which hardly come again, are found anew."""

    def __init__(self, find):
        super().__init__()
        self.find = find
        self.bytes = 0

    def __missing__(self, part: str):
        out = self.find(part)
        if len(part) <= REMEMBERED:
            self.bytes += 250 + 2 * len(part)  # text, result and their place
            if self.bytes > MEMORY_BYTES:
                self.clear()
                self.bytes = 0
            self[part] = out
        return out


@dataclass
class Segmenter:
    """One worker's automaton and memory."""

    vocabulary: Vocabulary

    def __post_init__(self):
        v = self.vocabulary
        self.counts = Memory(self.count_segment)  # count << SCORE_BITS, less the score
        self.ids = Memory(self.encode_segment)  # int32
        self.found = ahocorasick.Automaton()
        for i, (piece, score) in enumerate(zip(v.pieces, v.scores)):
            if score is not None:
                self.found.add_word(piece, (len(piece), score, i))
        self.found.make_automaton()
        live = [p for p, s in zip(v.pieces, v.scores) if s is not None]
        self.longest = v.longest
        self.unknown = min(s for s in v.scores if s is not None) - UNKNOWN_PENALTY
        # Places that no piece reaches across: before a space mark that follows anything else, and around line ends.
        marks = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in live)
        lines = not any("\n" in p for p in live)
        solid = f"[^{SPACE}\n]" if lines else f"[^{SPACE}]"
        self.segment = re.compile(f"{SPACE}+{solid}*|{solid}+" + ("|\n" if lines else "")) if marks else re.compile(r"(?s).+")
        self.cuts = re.compile(f"(?<=[^{SPACE}])(?={SPACE})" + (f"|(?<=\n)(?=[^{SPACE}])|(?=\n)" if lines else "")) if marks else None
        self.bytes = [p.replace(SPACE, " ").encode("utf-8", "surrogatepass") for p in v.pieces]
        for b, i in enumerate(v.byte_ids):
            self.bytes[i] = bytes([b])
        for i, s in enumerate(v.scores):
            if s is None and i not in v.byte_ids:
                self.bytes[i] = b""

    def normalize(self, text: str) -> str:
        return (SPACE if self.vocabulary.prefix else "") + text.replace(" ", SPACE) if text else ""

    def forward(self, part: str, size: int, seeds: dict[int, int]) -> tuple[list[int], list[tuple[int, int] | None]]:
        """Best scores of all positions of ``part``, and how each is reached: (start, piece id), -1 for the character itself, None for a seed.

        ``seeds`` has the scores of positions that pieces from before ``part``
        reach; pieces start before ``size`` and may reach beyond.
        """
        n = len(part)
        by_end: list[list[tuple[int, int, int]]] = [[] for _ in range(n + 1)]
        for end, match in self.found.iter(part):
            by_end[end + 1].append(match)
        best = [NONE] * (n + 1)
        back: list[tuple[int, int] | None] = [None] * (n + 1)
        for e in range(n + 1):
            top, how = seeds.get(e, NONE), None
            alone = False
            for length, score, i in by_end[e]:  # the longest, which starts first, comes first
                s = e - length
                if length == 1:
                    alone = True
                if s < size and best[s] != NONE and best[s] + score > top:
                    top, how = best[s] + score, (s, i)
            if not alone and 0 < e <= size and best[e - 1] != NONE and best[e - 1] + self.unknown > top:
                top, how = best[e - 1] + self.unknown, (e - 1, -1)
            best[e], back[e] = top, how
        return best, back

    def trace(self, part: str, back: list[tuple[int, int] | None], at: int) -> tuple[int, list[int]]:
        """The seed from which position ``at`` is reached, and the ids on the way."""
        out: list[int] = []
        while back[at] is not None:
            at, i = back[at]
            if i >= 0:
                out.append(i)
            else:
                out += [self.vocabulary.byte_ids[b] for b in reversed(part[at].encode("utf-8", "surrogatepass"))]
        return at, out[::-1]

    def count_segment(self, part: str) -> int:
        """The count and score of one segment; memory holds its positions, and no piece of it."""
        n, unknown = len(part), self.unknown
        best, count, single = [0] + [NONE] * n, [0] * (n + 1), [False] * (n + 1)
        e = 0
        for end, (length, score, _) in self.found.iter(part):
            while e < end:  # all matches that end before are in
                if not single[e] and best[e] + unknown > best[e + 1]:
                    best[e + 1], count[e + 1] = best[e] + unknown, count[e] + len(part[e].encode("utf-8", "surrogatepass"))
                e += 1
            s = end + 1 - length
            if length == 1:
                single[end] = True
            score += best[s]
            if score > best[end + 1]:  # the longest came first
                best[end + 1], count[end + 1] = score, count[s] + 1
        while e < n:
            if not single[e] and best[e] + unknown > best[e + 1]:
                best[e + 1], count[e + 1] = best[e] + unknown, count[e] + len(part[e].encode("utf-8", "surrogatepass"))
            e += 1
        return (count[n] << SCORE_BITS) - best[n]

    def encode_segment(self, part: str) -> bytes:
        """The ids of one segment."""
        n, unknown = len(part), self.unknown
        best, back, single = [0] + [NONE] * n, [(0, -1)] * (n + 1), [False] * (n + 1)
        e = 0
        for end, (length, score, i) in self.found.iter(part):
            while e < end:
                if not single[e] and best[e] + unknown > best[e + 1]:
                    best[e + 1], back[e + 1] = best[e] + unknown, (e, -1)
                e += 1
            s = end + 1 - length
            if length == 1:
                single[end] = True
            score += best[s]
            if score > best[end + 1]:
                best[end + 1], back[end + 1] = score, (s, i)
        while e < n:
            if not single[e] and best[e] + unknown > best[e + 1]:
                best[e + 1], back[e + 1] = best[e] + unknown, (e, -1)
            e += 1
        out = []
        while n:
            n, i = back[n]
            if i >= 0:
                out.append(i)
            else:
                out += [self.vocabulary.byte_ids[b] for b in reversed(part[n].encode("utf-8", "surrogatepass"))]
        out.reverse()
        return array("i", out).tobytes()

    def count_all(self, texts: list[str]) -> list[tuple[int, int]]:
        """Pieces and score of whole texts."""
        out = []
        for t in texts:
            total = sum(map(self.counts.__getitem__, self.segment.findall(self.normalize(t))))
            out.append((total >> SCORE_BITS, -(total & _LOW)))
        return out

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of whole texts."""
        return [np.frombuffer(b"".join(map(self.ids.__getitem__, self.segment.findall(self.normalize(t)))), np.int32) for t in texts]

    def count(self, text: str) -> tuple[int, int]:
        return self.count_all([text])[0]

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0].tolist()

    def decode(self, ids: list[int]) -> str:
        raw = b"".join(map(self.bytes.__getitem__, ids))
        if self.vocabulary.prefix and raw[:1] == b" ":
            raw = raw[1:]
        return raw.decode("utf-8", "replace")


_WORKER: dict[int, Segmenter] = {}


def worker_segmenter(shared) -> Segmenter:
    """The segmenter of this worker process for a broadcast vocabulary."""
    key = shared.id if hasattr(shared, "id") else id(shared)
    if key not in _WORKER:
        _WORKER.clear()
        _WORKER[key] = Segmenter(shared.value)
    return _WORKER[key]
