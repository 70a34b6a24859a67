"""SentencePiece encoding and decoding by a max-plus scan.

A text's best segmentation into pieces is a longest path. Cutting a text into chunks turns each chunk into a matrix over
boundary states (how far the piece that crosses a boundary reaches into the next chunk); matrices combine associatively by
max-plus products, the best states at the boundaries follow, and each chunk is then traced back on its own. Where every
piece ends at some forced position, the matrix is an outer sum of two vectors, which is all that is computed there.

Of several best paths one is chosen by a second sum, of a number for each cut by its place within its segment, that is
compared where scores are equal. So ids do not depend on how a text is cut into chunks.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordcheck.llm.common import materialize, table

SPACE = "▁"
#: Code points of a chunk; longer texts are scanned chunk by chunk in tasks of their own. Chunks of a block that is combined.
CHUNK, BLOCK = 1 << 16, 256
#: Segments whose best pieces a task remembers, each of so many code points at most.
REMEMBERED, SHORT = 600_000, 32
#: Segments whose paths are searched at once, and bits of a hash that tell most strings from beginnings of pieces.
SLICE, MARK_BITS = 1 << 15, 18
#: What a character outside the vocabulary scores below the least piece. Scores are rounded to so many parts of one, which
#: makes their sums exact in any order.
UNKNOWN, GRAIN = 10.0, 1024


def tie(place: int) -> float:
    """What a cut counts where scores are equal, by its place within its segment (20 bits of a multiplicative hash)."""
    return float((place * 2654435761 & 0xFFFFFFFF) >> 12)


class Pieces:
    """Pieces of a model file and their scores, taken as a unigram model; the file is read where the tasks run."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.vocab_size()
        code = [k.to_bytes(4, "little") for k in range(size)]
        self.bytes = {int(sp.id_to_piece(k)[3:5], 16): code[k] for k in range(size) if sp.is_byte(k)}
        skip = lambda k: sp.is_byte(k) or sp.is_control(k) or sp.is_unknown(k) or sp.is_unused(k)
        names = {k: sp.id_to_piece(k) for k in range(size) if not skip(k)}
        self.names = names
        self.of = {p: round(sp.get_score(k) * GRAIN) / GRAIN for k, p in names.items()}
        self.code = {p: code[k] for k, p in names.items()}
        self.unknown_code = code[sp.unk_id()]
        self.unknown = min(self.of.values(), default=0.0) - UNKNOWN
        self.longest = max(map(len, self.of), default=1)
        values = {int.from_bytes(c, "little"): b for b, c in self.bytes.items()}
        self.raw = [bytes([values[k]]) if k in values else names.get(k, "").replace(SPACE, " ").encode() for k in range(size)]
        # Beginnings of pieces score as no path does, so that a search along the text knows where to end.
        for p in names.values():
            for k in range(1, len(p)):
                self.of.setdefault(p[:k], -np.inf)
        # Before a space mark that follows another character every segmentation is cut, if no piece reaches over that.
        forced = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in names.values())
        self.segments = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+" if forced else r"[\s\S]+")
        self.known: dict[str, tuple[bytes, float]] = {}
        # Pieces and their beginnings of each length by a hash of their code points, for the search over many segments at once.
        self.factors = np.random.default_rng(42).integers(1, 1 << 63, self.longest, np.uint64) * np.uint64(2) + np.uint64(1)
        self.table: list[tuple[np.ndarray, ...]] = []
        number = {p: k for k, p in names.items()}
        for n in range(1, self.longest + 1):
            of = [p for p in self.of if len(p) == n]
            points = np.frombuffer("".join(of).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64).reshape(-1, n)
            keys = (points * self.factors[:n]).sum(1, dtype=np.uint64)
            order = np.argsort(keys)
            marks = np.zeros(1 << MARK_BITS, bool)
            marks[keys >> np.uint64(64 - MARK_BITS)] = True
            self.table.append((marks, keys[order], points[order], np.array([self.of[p] for p in of])[order], np.array([number.get(p, -1) for p in of], np.int64)[order]))
        self.cut_ties = np.array([tie(k) for k in range(SHORT + 1)])
        raw = [np.frombuffer(r, np.uint8) for r in self.raw]
        self.pool, self.widths = np.concatenate(raw), np.array([len(r) for r in raw], np.int64)
        self.places = np.cumsum(self.widths) - self.widths

    @staticmethod
    def normalize(text: str | None) -> str:
        """Spaces as space marks, one before the text; nothing else is changed."""
        return SPACE + text.replace(" ", SPACE) if text else ""

    def ties(self, text: str, offset: int = 0) -> list[float]:
        """What a cut at each position counts; text begins `offset` code points into its first segment."""
        out = [0.0]
        for m in self.segments.finditer(text):
            before = 0 if m.start() else offset
            out += [tie(before + k) for k in range(1, m.end() - m.start() + 1)]
        return out

    def paths(self, text: str, start: int = 0, stop: int | None = None, offset: int = 0) -> tuple[list[float], list[float], list[int]]:
        """Best score from `start` to each position, its ties, and where its last piece begins, over pieces that begin before
        `stop`."""
        stop = len(text) if stop is None else stop
        best, begin = [-np.inf] * (len(text) + 1), [-1] * (len(text) + 1)
        best[start] = 0.0
        of, longest, unknown, lost = self.of, self.longest, self.unknown, -np.inf
        cuts, tied = self.ties(text, offset), [0.0] * (len(text) + 1)
        for i in range(start, stop):
            here = best[i]
            if here == -np.inf:
                continue
            for j in range(i + 1, min(i + longest, len(text)) + 1):
                score = of.get(text[i:j])
                if j == i + 1 and (score is None or score == lost):
                    reached, more = here + unknown, score is not None
                elif score is None:
                    break
                else:
                    reached, more = here + score, True
                if reached > best[j] or reached == best[j] > lost and tied[i] + cuts[j] > tied[j]:
                    best[j], tied[j], begin[j] = reached, tied[i] + cuts[j], i
                if not more:
                    break
        return best, tied, begin

    def trace(self, text: str, begin: list[int], end: int) -> bytes:
        out: list[bytes] = []
        while (start := begin[end]) >= 0:
            code = self.code.get(text[start:end])
            if code is not None:
                out.append(code)
            else:
                out.append(self.spelled(text[start:end]))
            end = start
        return b"".join(reversed(out))

    def spelled(self, character: str) -> bytes:
        """Codes of a character outside the vocabulary: of its bytes where the model has them, else the unknown one."""
        return b"".join([self.bytes[b] for b in character.encode("utf-8", "surrogatepass")]) if self.bytes else self.unknown_code

    def learn(self, segments: Iterable[str]) -> None:
        """Codes and scores of segments."""
        short = [s for s in segments if len(s) <= SHORT]
        for k in range(0, len(short), SLICE):
            self._learn_short(short[k : k + SLICE])
        for s in segments:
            if s not in self.known:
                best, _, begin = self.paths(s)
                self.known[s] = self.trace(s, begin, len(s)), best[-1]

    def _learn_short(self, segments: list[str]) -> None:
        """The same paths as of `paths`, for all segments at once."""
        size = np.array([len(s) for s in segments], np.int64)
        points = np.frombuffer("".join(segments).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        start = np.cumsum(size) - size
        owner = np.repeat(np.arange(len(segments)), size)
        local = np.arange(len(points)) - start[owner]
        left = size[owner] - local
        steps = []  # (first character, length, score, id) of every piece that occurs
        at, key = np.arange(len(points)), np.zeros(len(points), np.uint64)
        for n, (marks, keys, spelling, scores, ids) in enumerate(self.table, 1):
            goes_on = left[at] >= n
            at = at[goes_on]
            key = key[goes_on] + points[at + n - 1] * self.factors[n - 1]
            lone = at
            maybe = np.flatnonzero(marks[key >> np.uint64(64 - MARK_BITS)])
            at, key = at[maybe], key[maybe]
            if len(at):
                k = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                same = (keys[k] == key) & (points[at[:, None] + np.arange(n)] == spelling[k]).all(1)
                at, key, k = at[same], key[same], k[same]
                hit = ids[k] >= 0
                steps.append((at[hit], np.full(hit.sum(), n), scores[k[hit]], ids[k[hit]]))
            if n == 1:
                lone = np.setdiff1d(lone, steps[-1][0] if steps else [], assume_unique=True)
                steps.append((lone, np.full(len(lone), n), np.full(len(lone), self.unknown), np.full(len(lone), -1)))
            if not len(at):
                break
        first, length, score, ids = (np.concatenate(c) for c in zip(*steps))
        group = local[first] * (self.longest + 1) + length
        order = np.argsort(group.astype(np.uint16) if SHORT * (self.longest + 1) < 1 << 16 else group, kind="stable")
        first, length, score, ids, group = first[order], length[order], score[order], ids[order], group[order]
        bounds = np.flatnonzero(np.r_[True, group[1:] != group[:-1], True])
        nodes = len(points) + len(segments)  # one more than characters for each segment
        begins = start + np.arange(len(segments))
        best, tied, back, code = np.full(nodes, -np.inf), np.zeros(nodes), np.zeros(nodes, np.int64), np.full(nodes, -1)
        best[begins] = 0.0
        for a, b in zip(bounds[:-1], bounds[1:]):
            i = first[a:b] + owner[first[a:b]]
            j = i + length[a:b]
            reached, ties = best[i] + score[a:b], tied[i] + self.cut_ties[local[first[a]] + length[a]]
            better = (reached > best[j]) | (reached == best[j]) & (ties > tied[j])
            i, j = i[better], j[better]
            best[j], tied[j], back[j], code[j] = reached[better], ties[better], i, ids[a:b][better]
        ends = begins + size
        here, whose, found = ends, np.arange(len(segments)), []
        while len(here):
            found.append((whose, code[here]))
            here = back[here]
            open_ = here != begins[whose]
            here, whose = here[open_], whose[open_]
        whose = np.concatenate([f[0] for f in reversed(found)])
        ids = np.concatenate([f[1] for f in reversed(found)])[np.argsort(whose, kind="stable")]
        stop = np.cumsum(np.bincount(whose, minlength=len(segments)))
        raw, lost = ids.astype("<u4").tobytes(), np.zeros(len(segments), bool)
        lost[np.searchsorted(stop, np.flatnonzero(ids < 0), "right")] = True
        a = 0
        for s, b, total, some in zip(segments, stop.tolist(), best[ends].tolist(), lost.tolist()):
            codes = raw[4 * a : 4 * b]
            if some:
                at, parts = 0, []
                for k in ids[a:b].tolist():
                    parts.append(k.to_bytes(4, "little") if k >= 0 else self.spelled(s[at]))
                    at += len(self.names[k]) if k >= 0 else 1
                codes = b"".join(parts)
            self.known[s] = codes, total
            a = b

    def encode_many(self, texts: list[str]) -> list[tuple[bytes, float]]:
        """Ids (little-endian, four bytes each) and score of the best segmentation of each normalised text."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        out: list[tuple[bytes, float]] = [(b"", 0.0)] * len(texts)
        waiting, fresh = [], set()
        for k, text in enumerate(texts):
            segments = self.segments.findall(text)
            found = list(map(self.known.get, segments))
            if None in found:
                fresh.update([s for s, f in zip(segments, found) if f is None])
                waiting.append((k, segments))
            else:
                out[k] = b"".join([f[0] for f in found]), float(sum([f[1] for f in found]))
        self.learn(fresh)
        get = self.known.__getitem__
        for k, segments in waiting:
            found = list(map(get, segments))
            out[k] = b"".join([f[0] for f in found]), float(sum([f[1] for f in found]))
        for s in fresh:
            if len(s) > SHORT:
                del self.known[s]
        return out

    def encode(self, text: str) -> tuple[bytes, float]:
        return self.encode_many([text])[0]

    def decode_many(self, ids: list[bytes]) -> list[str]:
        """The texts that ids stand for, without the space mark before them."""
        flat = np.frombuffer(b"".join(ids), "<u4")
        widths = self.widths[flat]
        ends = np.cumsum(widths)
        total = int(ends[-1]) if len(ends) else 0
        data = self.pool[np.arange(total) + np.repeat(self.places[flat] - ends + widths, widths)].tobytes()
        stops = np.r_[0, ends][np.cumsum([len(x) // 4 for x in ids])].tolist() if ids else []
        return [data[a:b].decode("utf-8", "replace").removeprefix(" ") for a, b in zip([0, *stops], stops)]

    def decode(self, ids: bytes) -> str:
        return self.decode_many([ids])[0]

    def fixed(self, text: str, size: int) -> tuple[int, int] | None:
        """First and last forced cut of a chunk that all boundary states share; None if there is no such cut."""
        first = next((m.end() for m in self.segments.finditer(text) if m.end() >= self.longest - 1), None)
        if first is None or first > size or first >= len(text):
            return None
        last = first
        for m in self.segments.finditer(text, first):
            if m.end() > size or m.end() >= len(text):
                break
            last = m.end()
        return first, last

    def transfer(self, text: str, size: int, offset: int = 0) -> np.ndarray:
        """Scores and ties over (state before, state after) of a chunk of `size` characters that is followed by the look-ahead
        and begins `offset` characters into a segment.

        State d before: the first cut at or after the chunk's begin is d characters into it; likewise after its end.
        """
        states = max(1, self.longest)
        out = np.stack([np.full((states, states), -np.inf), np.zeros((states, states))])
        cut = self.fixed(text, size)

        def reach(found: tuple, k: int) -> np.ndarray:
            best, tied, _ = found
            at = [size - k + d for d in range(states)]
            return np.array([[best[p] if p < len(best) else -np.inf for p in at], [tied[p] if p < len(best) else 0.0 for p in at]])

        if cut is None:
            for d in range(min(states, size + 1)):
                out[:, d] = reach(self.paths(text, d, size, offset), 0)
            # A piece may reach over the whole chunk.
            for d in range(size + 1, states):
                if d - size < states:
                    out[0, d, d - size] = 0.0
            return out
        first, last = cut
        head = np.stack([np.full(states, -np.inf), np.zeros(states)])
        for d in range(min(states, first + 1)):
            best, tied, _ = self.paths(text[:first], d, None, offset)
            head[:, d] = best[first], tied[first]
        _, inner = self.encode(text[first:last])
        out = head[:, :, None] + reach(self.paths(text[last:], 0, size - last), last)[:, None, :]
        out[0] += inner
        return out

    def between(self, text: str, size: int, before: int, after: int, offset: int = 0) -> tuple[bytes, float]:
        """Ids and score of a chunk whose boundary states are known."""
        if before > size:
            return b"", 0.0
        cut = self.fixed(text, size)
        if cut is None:
            best, _, begin = self.paths(text, before, size, offset)
            return self.trace(text, begin, size + after), best[size + after]
        first, last = cut
        best, _, begin = self.paths(text[:first], before, None, offset)
        ids, inner = self.encode(text[first:last])
        rest = text[last:]
        ends, _, back = self.paths(rest, 0, size - last)
        end = size - last + after
        return self.trace(text[:first], begin, first) + ids + self.trace(rest, back, end), best[first] + inner + ends[end]

    def chunks(self, text: str, chunk: int) -> Iterator[tuple[str, int, int]]:
        """Chunks of a normalised text with their look-ahead, their sizes and how far into a segment they begin."""
        starts = np.array([m.start() for m in self.segments.finditer(text)], np.int64)
        for at in range(0, len(text), chunk):
            began = int(starts[np.searchsorted(starts, at, "right") - 1])
            yield text[at : at + chunk + self.longest - 1], min(chunk, len(text) - at), at - began


def _ahead(before: np.ndarray, matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums over the states between (first axis) of scores and ties, and the best of them: the most ties of the best scores."""
    score, ties = before[0] + matrix[0], before[1] + matrix[1]
    ties = np.where(score == score.max(axis=0), ties, -np.inf)
    return np.stack([score.max(axis=0), ties.max(axis=0)]), ties.argmax(axis=0)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product of matrices of scores and ties."""
    return _ahead(a.transpose(0, 2, 1)[:, :, :, None], b[:, :, None, :])[0]


def best_states(matrices: list[np.ndarray], first: int, last: int) -> list[int]:
    """The state at every boundary of a run of chunks on the best path between its outer states."""
    states = matrices[0].shape[1]
    ahead = [np.stack([np.full(states, -np.inf), np.zeros(states)])]
    ahead[0][0, first] = 0.0
    for m in matrices:
        ahead.append(_ahead(ahead[-1][:, :, None], m)[0])
    found = [last]
    for k in range(len(matrices) - 1, -1, -1):
        found.append(int(_ahead(ahead[k][:, :, None], matrices[k][:, :, found[-1] :][:, :, :1])[1][0]))
    return found[::-1]


def _chunks(path: str, chunk: int):
    """Rows (row, text) -> their chunks with look-ahead and transfer matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(path)
        for b in batches:
            for row, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for k, (part, size, offset) in enumerate(pieces.chunks(pieces.normalize(text), chunk)):
                    longs = [pa.array([x], pa.int64()) for x in (row, k // BLOCK, k, size, offset)]
                    yield pa.RecordBatch.from_arrays([*longs, pa.array([part])], names=["row", "block", "chunk", "size", "offset", "text"])

    return run


def _transfer(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(path)
        for b in batches:
            found = [pieces.transfer(*r).tobytes() for r in zip(*(b.column(c).to_pylist() for c in ("text", "size", "offset")))]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in ("row", "block", "chunk")] + [pa.array(found, pa.binary())], names=["row", "block", "chunk", "m"])

    return run


def _matrix(raw: bytes) -> np.ndarray:
    flat = np.frombuffer(raw)
    return flat.reshape(2, int((len(flat) // 2) ** 0.5), -1)


def _combine(group: pd.DataFrame) -> pd.DataFrame:
    """Chunks of a block -> the block's matrix, by a tree of products."""
    run = [_matrix(m) for m in group.sort_values("chunk")["m"]]
    while len(run) > 1:
        run = [product(run[k], run[k + 1]) if k + 1 < len(run) else run[k] for k in range(0, len(run), 2)]
    return pd.DataFrame({"row": [group["row"].iloc[0]], "block": [group["block"].iloc[0]], "m": [run[0].tobytes()]})


def _outer(group: pd.DataFrame) -> pd.DataFrame:
    """Blocks of a text -> the states at their ends; a text begins and ends with a cut."""
    group = group.sort_values("block")
    states = best_states([_matrix(m) for m in group["m"]], 0, 0)
    return pd.DataFrame({"row": group["row"], "block": group["block"], "before": states[:-1], "after": states[1:]})


def _inner(chunks: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
    """Chunks of a block and the states at its ends -> the states at each chunk's ends."""
    if not len(chunks) or not len(block):
        return pd.DataFrame({"row": [], "chunk": [], "before": [], "after": []})
    chunks = chunks.sort_values("chunk")
    states = best_states([_matrix(m) for m in chunks["m"]], int(block["before"].iloc[0]), int(block["after"].iloc[0]))
    return pd.DataFrame({"row": chunks["row"], "chunk": chunks["chunk"], "before": states[:-1], "after": states[1:]})


def _between(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(path)
        for b in batches:
            got = [pieces.between(*r) for r in zip(*(b.column(c).to_pylist() for c in ("text", "size", "before", "after", "offset")))]
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("chunk"), pa.array([g[0] for g in got], pa.binary()), pa.array([float(g[1]) for g in got])], names=["row", "chunk", "ids", "score"])

    return run


def scan_encode(long: DataFrame, path: str, chunk: int = CHUNK) -> DataFrame:
    """Stored rows (row, text) of long texts -> (row, chunk, ids, score), each chunk's ids apart. Chunks are dealt to a given
    number of tasks, as there may be few of them that each take long."""
    tasks = int(long.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = ["row", "chunk", "size", "offset", "text"]
    cut = long.select("row", "text").mapInArrow(_chunks(path, chunk), "row bigint, block bigint, chunk bigint, size bigint, offset bigint, text string")
    cut = materialize(cut.repartition(tasks, "row", "chunk"), "pieces-chunks")
    moved = materialize(cut.mapInArrow(_transfer(path), "row bigint, block bigint, chunk bigint, m binary"), "pieces-matrices")
    blocks = moved.groupBy("row", "block").applyInPandas(_combine, "row bigint, block bigint, m binary")
    outer = blocks.groupBy("row").applyInPandas(_outer, "row bigint, block bigint, before bigint, after bigint")
    states = moved.groupBy("row", "block").cogroup(outer.groupBy("row", "block")).applyInPandas(_inner, "row bigint, chunk bigint, before bigint, after bigint")
    placed = cut.select(*names).join(states, ["row", "chunk"]).repartition(tasks, "row", "chunk")
    return placed.select(*names, "before", "after").mapInArrow(_between(path), "row bigint, chunk bigint, ids binary, score double")


def _whole(path: str, fields: list[str], at: int, check: bool):
    """Rows with a text at a place -> with ids and score, and with the text that the ids decode to if `check`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(path)
        for b in batches:
            for k in range(0, b.num_rows, 512):
                part = b.slice(k, 512)
                got = pieces.encode_many([pieces.normalize(t) for t in part.column(at).cast(pa.string()).to_pylist()])
                made = [pa.array([g[0] for g in got], pa.binary()), pa.array([float(g[1]) for g in got])]
                back = [pa.array(pieces.decode_many([g[0] for g in got]), pa.string())] if check else []
                yield pa.RecordBatch.from_arrays([*part.columns, *made, *back], names=[*fields, "ids", "score", *["decoded"] * check])

    return run


def encode(docs: DataFrame, path: str | None = None, text_col: str = "text", chunk: int = CHUNK, check: bool = False) -> DataFrame:
    """Rows of docs with ids (little-endian, four bytes each) and score, which replace columns of these names; with `check`
    also decoded, as `decode` gives it, without a second pass over the ids of texts that are not scanned.

    The model's pieces and scores are taken as a unigram model: ids are those of a segmentation with the largest summed
    score, the same for every `chunk`. Characters outside the vocabulary become bytes where the model has them, else its
    unknown id; a literal U+2581 is decoded as a space. Null and empty texts have no ids and score 0. Texts over `chunk` code points are scanned in chunks, spread over tasks.
    """
    path = path or public_tokenizers.path("piece_bpe_32k.model")
    own = docs.select(*[c for c in docs.columns if c not in ("ids", "score", *["decoded"] * check)])
    long = F.coalesce(F.char_length(F.col(text_col).cast("string")) >= chunk, F.lit(False))
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in own.schema.fields)
    run = _whole(path, own.columns, own.columns.index(text_col), check)
    short = own.filter(~long).mapInArrow(run, f"{fields}ids binary, score double" + ", decoded string" * check)
    kept = materialize(own.filter(long).withColumn("__row", F.monotonically_increasing_id()), "pieces-long")
    parts = scan_encode(kept.select(F.col("__row").alias("row"), F.col(text_col).cast("string").alias("text")), path, chunk)
    joined = parts.groupBy(F.col("row").alias("__row")).agg(F.sort_array(F.collect_list(F.struct("chunk", "ids", "score"))).alias("__parts"))
    ids = F.aggregate("__parts", F.lit(b""), lambda acc, p: F.concat(acc, p["ids"]))
    score = F.aggregate("__parts", F.lit(0.0), lambda acc, p: acc + p["score"])
    whole = kept.join(joined, "__row").select(*own.columns, ids.alias("ids"), score.alias("score"))
    return short.unionByName(decode(whole, path) if check else whole)


def decode(encoded: DataFrame, path: str | None = None, ids_col: str = "ids") -> DataFrame:
    """Rows of encoded with decoded, the text that the ids stand for; null ids give null."""
    path = path or public_tokenizers.path("piece_bpe_32k.model")
    own = encoded.select(*[c for c in encoded.columns if c != "decoded"])
    names = own.columns
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in own.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(path)
        at = names.index(ids_col)
        for b in batches:
            for k in range(0, b.num_rows, 512):
                part = b.slice(k, 512)
                ids = part.column(at).to_pylist()
                texts = [None if x is None else t for x, t in zip(ids, pieces.decode_many([x or b"" for x in ids]))]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*names, "decoded"])

    return own.mapInArrow(run, f"{fields}decoded string")


def op6_pieces(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")

    back = encode(docs, check=True)
    return back.select("doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_ids"), F.crc32("ids").alias("ids_crc32"), F.round("score", 3).alias("score"), (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))
