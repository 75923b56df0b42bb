"""Byte-level BPE tokenizer files: units of text that are encoded on their own, library ids, and
the number of tokens of every prefix.

A text's ids are the concatenation of its units' ids: a unit begins where the tokenizer's own
split pattern always begins a piece, whatever surrounds it. So each distinct unit is worked out
once and the result is kept in a bounded store."""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from .unit_table import UnitTable, name_hashes, runs

#: White space as the tokenizer's pattern knows it (Unicode White_Space).
_WS = r"\t-\r \x85\xa0  -     　"
_ENDING = "'(?:s|t|re|ve|m|ll|d)"
#: The tokenizer's split pattern. Fixed values.
PIECES = regex.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+"
)
#: White space with what follows it: no piece crosses the border of two units.
UNITS = regex.compile(
    rf"{_ENDING}|[{_WS}]*[^ \P{{White_Space}}]{_ENDING}|[{_WS}]*\p{{L}}+|[{_WS}]*\p{{N}}+|[{_WS}]*[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+"
)
_RUN = regex.compile(rf"[{_WS}]{{2}}")
#: How the vocabulary file writes a space.
SPACE = "\u0120"
#: Units of one generation; a worker keeps two generations of them, in tables of some 50 bytes a unit. What drops out is
#: encoded again when it comes again, so two generations should hold most words of a corpus (1.2 million here).
KEPT_UNITS = 700_000
#: What is kept in dictionaries, which take several times as much an entry: units of other forms, pairs of tokens.
KEPT_OTHERS, KEPT_PAIRS = 75_000, 300_000
#: Bytes from which a piece is worked out by itself.
LONG_PIECE = 256


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class UnitStore:
    """Bytes for every text, joined from what `work` gives for its units."""

    #: What the bytes are: ids, or steps.
    item = "<u4"

    def __init__(self, specials: tuple[str, ...]):
        self.after_space, self.before = UnitTable(self.item), UnitTable(self.item)
        self.other: dict[str, bytes] = {}
        self.special = regex.compile("|".join(map(regex.escape, sorted(specials, key=len, reverse=True)))) if specials else None

    def work(self, todo: list[str]) -> list[bytes]:
        """The bytes of units."""
        raise NotImplementedError

    def work_spaced(self, names: list[str]) -> list[bytes]:
        """The bytes of units that are a space and a name without white space at its ends."""
        return self.work([" " + x for x in names])

    def learn(self, names: pa.Array) -> np.ndarray:
        """The entry in `after_space` of each of different units that follow a space; units not yet known are worked out.
        -1: a unit that begins or ends in white space, so that what is beside it counts."""
        if len(self.after_space) > KEPT_UNITS:
            self.before, self.after_space = self.after_space, UnitTable(self.item)
        first, second = name_hashes(names)
        lost = np.flatnonzero(self.after_space.find(first, second) < 0)
        old = self.before.find(first[lost], second[lost])
        if (again := old >= 0).any():
            self.after_space.add(first[lost[again]], second[lost[again]], *self.before.taken(old[again]))
        lost = lost[~again]
        texts = names.take(pa.array(lost)).to_pylist()
        whole = np.fromiter((bool(x) and x == x.strip() for x in texts), bool, len(texts))
        lost, texts = lost[whole], [x for x, ok in zip(texts, whole.tolist(), strict=True) if ok]
        for at in range(0, len(lost), 50_000):
            part = lost[at : at + 50_000]
            found = self.work_spaced(texts[at : at + 50_000])
            data = np.frombuffer(b"".join(found), self.item)
            size = np.fromiter(map(len, found), np.int32, len(found)) // data.itemsize
            self.after_space.add(first[part], second[part], size, data)
        return self.after_space.find(first, second)

    def slows(self, texts: list[str]) -> list[bytes]:
        """The bytes of texts, unit by unit."""
        found = list(map(UNITS.findall, texts))
        if len(self.other) > KEPT_OTHERS:
            self.other.clear()
        new = list({u for x in found for u in x if u not in self.other})
        self.other.update(zip(new, self.work(new), strict=True))
        return [b"".join(map(self.other.__getitem__, x)) for x in found]

    def plains(self, texts: list[str]) -> list[bytes]:
        """The bytes of texts without special strings. Each different unit of the batch is looked
        up once."""
        if not texts:
            return []
        lists = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        offsets = lists.offsets.to_numpy()
        flat = lists.values.dictionary_encode()
        index, names = flat.indices.to_numpy().astype(np.int64), flat.dictionary
        inner = np.ones(len(index), bool)
        inner[offsets[:-1]] = False
        used = np.zeros(len(names), bool)
        used[index[inner]] = True
        wanted = np.flatnonzero(used)
        found = self.learn(names.take(pa.array(wanted)))
        edge = np.zeros(len(names) + len(texts), bool)
        edge[wanted] = found < 0
        single = np.diff(offsets) == 1
        heads = names.take(pa.array(index[offsets[:-1]])).to_pylist()
        # a head with white space at its ends counts what is beside it
        alone = [bool(one or x and x == x.strip()) for one, x in zip(single, heads, strict=True)]
        edge[len(names) :] = ~np.array(alone)
        units = self.slows([x if ok else "" for x, ok in zip(heads, alone, strict=True)])
        own = np.frombuffer(b"".join(units), self.item)
        known = self.after_space
        # the numbers of units: those of the table, then those of the heads
        begin, sizes = np.zeros(len(edge), np.int64), np.zeros(len(edge), np.int64)
        begin[wanted], sizes[wanted] = np.append(known.begin, 0)[found], np.append(known.size, 0)[found]
        sizes[len(names) :] = np.fromiter(map(len, units), np.int64, len(units)) // own.itemsize
        begin[len(names) :] = len(known.data) + np.cumsum(sizes[len(names) :]) - sizes[len(names) :]
        blob = np.concatenate([known.data, own])
        index[offsets[:-1]] = len(names) + np.arange(len(texts))
        n = sizes[index]
        ends = np.cumsum(n)
        at = runs(begin[index], n)
        raw = blob.take(at).tobytes()
        cuts = (np.concatenate([[0], ends])[offsets] * blob.itemsize).tolist()
        out = [raw[i:j] for i, j in zip(cuts, cuts[1:])]
        if edge.any():
            odd = np.flatnonzero(np.add.reduceat(edge[index], offsets[:-1]))
            for k, value in zip(odd, self.slows([texts[k] for k in odd]), strict=True):
                out[k] = value
        return out

    def plain(self, text: str) -> bytes:
        return self.plains([text])[0]

    def batch(self, texts: list[str]) -> list[bytes]:
        find = self.special
        odd = [k for k, x in enumerate(texts) if find is not None and find.search(x)]
        marked = set(odd)
        out = self.plains([x for k, x in enumerate(texts) if k not in marked]) if odd else self.plains(texts)
        for k in odd:
            out.insert(k, self.marked(texts[k]))
        return out

    def marked(self, text: str) -> bytes:
        """The bytes of a text that holds special strings."""
        raise NotImplementedError


def _file(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        held = json.load(f)
    kind = held["model"]
    if kind["type"] != "BPE" or (held.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or held.get("normalizer"):
        raise ValueError(f"{path} is not a plain byte-level BPE tokenizer")
    if held["pre_tokenizer"].get("add_prefix_space") or any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in held["added_tokens"]):
        raise ValueError(f"{path}: prefix spaces and added tokens that take their surroundings are not covered")
    return held


class LibraryIds(UnitStore):
    """Ids as little-endian unsigned 32-bit integers; the tokenizers library encodes each unit."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__(tuple(t["content"] for t in _file(path)["added_tokens"]))
        self.library = Tokenizer.from_file(path)
        vocab = self.library.get_vocab()
        #: Which ids begin with a space.
        self.spaced = np.zeros(max(vocab.values()) + 1, bool)
        self.spaced[[i for x, i in vocab.items() if x.startswith(SPACE)]] = True

    def work_spaced(self, names: list[str]) -> list[bytes]:
        # one text of all units: no piece crosses their borders, and only a unit's first id begins with a space
        if not names:
            return []
        ids = np.array(self.library.encode_batch_fast([" " + " ".join(names)], add_special_tokens=False)[0].ids, "<u4")
        cuts = (np.append(np.flatnonzero(self.spaced[ids]), len(ids)) * 4).tolist()
        raw = ids.tobytes()
        return [raw[i:j] for i, j in zip(cuts, cuts[1:])]

    def work(self, todo: list[str]) -> list[bytes]:
        if not todo:
            return []
        e = self.library.encode(todo, is_pretokenized=True, add_special_tokens=False)
        ids, ends = np.array(e.ids, "<u4").tobytes(), np.zeros(len(todo) + 1, np.int64)
        ends[1:] = np.cumsum(np.bincount(np.array(e.word_ids, np.int64), minlength=len(todo))) * 4
        cuts = ends.tolist()
        return [ids[i:j] for i, j in zip(cuts, cuts[1:])]

    def marked(self, text: str) -> bytes:
        out, at = [], 0
        for m in self.special.finditer(text):
            out += [self.plain(text[at : m.start()]), np.array([self.library.token_to_id(m[0])], "<u4").tobytes()]
            at = m.end()
        return b"".join([*out, self.plain(text[at:])])


class PrefixCounts(UnitStore):
    """For each character of a text, by how much it changes the number of tokens (int16): the sum
    of the first n is the exact number of tokens of the text's first n characters.

    Dynamic programming over a piece's bytes: the encoding of b[:i] ends in the one token t for
    which the encoding of b[:i-len(t)] ends in a token that, with t, encodes to just these two.
    Pieces of like length are worked out together, as rows of a matrix. Tokens are numbered by
    the order of the merges that make them, single bytes first."""

    item = "<i2"

    def __init__(self, path: str):
        held = _file(path)
        super().__init__(tuple(t["content"] for t in held["added_tokens"]))
        code = byte_letters()
        raw = lambda s: bytes(map(code.__getitem__, s))
        number = {bytes([b]): b for b in range(256)}
        halves, merged = [(b, b) for b in range(256)], {}
        for m in held["model"]["merges"]:
            left, right = map(raw, m.split(" ") if isinstance(m, str) else m)
            l, r = number[left], number[right]
            n = number.setdefault(left + right, len(halves))
            if n == len(halves):
                halves.append((l, r))
            merged.setdefault((l, r), n)
        self.halves = np.array(halves, np.int64)
        keys = np.array([l << 20 | r for l, r in merged], np.int64)
        order = np.argsort(keys)
        self.pair, self.pair_makes = keys[order], np.array(list(merged.values()), np.int64)[order]
        self.longest = max(map(len, number))
        edge: dict[tuple[int, int], int] = {}
        made = [-1]
        for token, n in number.items():
            node = 0
            for byte in token:
                if (to := edge.get((node, byte))) is None:
                    to = edge[node, byte] = len(made)
                    made.append(-1)
                node = to
            made[node] = n
        self.made = np.array(made, np.int32)
        self.child = np.full(len(made) * 256, -1, np.int32)
        self.child[[node << 8 | byte for node, byte in edge]] = list(edge.values())
        self.single = self.keeps_whole()
        self.fitting: dict[int, bool] = {}

    def keeps_whole(self) -> np.ndarray:
        """Which tokens encode to themselves: those whose halves stay apart until they merge."""
        own = np.ones(len(self.halves), bool)
        rows = np.arange(256, len(own))
        left, right = self.halves[rows].T
        own[rows] = self.fits(left, right, rows)
        return own

    def fits(self, left: np.ndarray, right: np.ndarray, most: np.ndarray | None = None) -> np.ndarray:
        """Whether two tokens side by side encode to just these two. Undoes their merges from the
        latest on: no pair across the border may have had an earlier turn than what is undone.
        most: with it, only merges before this one count."""
        left, right = left.astype(np.int64), right.astype(np.int64)
        limit = np.full(len(left), 1 << 40, np.int64) if most is None else most.astype(np.int64)
        good, rows = np.ones(len(left), bool), np.arange(len(left))
        while len(rows):
            key = left << 20 | right
            at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
            clash = (self.pair[at] == key) & (self.pair_makes[at] < limit)
            good[rows[clash]] = False
            late_left = left > right
            # undo the later of the two; a single byte that is the later one leaves the other
            byte_left, byte_right = left < 256, right < 256
            undo_left = (late_left & ~byte_left) | (byte_right & ~byte_left)
            go = ~clash & ~(byte_left & byte_right)
            limit = np.where(undo_left, left, right + 1)
            left, right = np.where(undo_left, self.halves[left, 1], left), np.where(undo_left, right, self.halves[right, 0])
            rows, left, right, limit = rows[go], left[go], right[go], limit[go]
        return good

    def by_bytes(self, pieces: list[bytes]) -> np.ndarray:
        """Row by piece: the number of tokens of its first 0, 1, 2, ... bytes."""
        n = np.array(list(map(len, pieces)))
        wide = int(n.max())
        text = np.zeros((len(pieces), wide), np.uint8)
        text[np.arange(wide) < n[:, None]] = np.frombuffer(b"".join(pieces), np.uint8)
        last = np.full((len(pieces), wide + 1), -1, np.int32)
        count = np.zeros((len(pieces), wide + 1), np.int32)
        for j in range(wide):
            rows, found = np.flatnonzero(n > j), []
            node = np.zeros(len(rows), np.int64)
            for i in range(j + 1, min(wide, j + self.longest) + 1):
                node = self.child[node << 8 | text[rows, i - 1]]
                live = (node >= 0) & (n[rows] >= i)
                rows, node = rows[live], node[live].astype(np.int64)
                if not len(rows):
                    break
                token = self.made[node]
                take = (token >= 0) & (last[rows, i] < 0)
                found.append((rows[take], np.full(take.sum(), i), token[take].astype(np.int64)))
            if not found:
                continue
            rows, to, token = map(np.concatenate, zip(*found, strict=True))
            if j == 0:
                good = self.single[token]
            else:
                pairs, back = np.unique(last[rows, j].astype(np.int64) << 20 | token, return_inverse=True)
                good = self.fits(pairs >> 20, pairs & 0xFFFFF)[back]
            rows, to, token = rows[good], to[good], token[good]
            last[rows, to], count[rows, to] = token, count[rows, j] + 1
        return count

    def fit(self, left: int, right: int) -> bool:
        """`fits` of one pair, held once worked out."""
        key = left << 20 | right
        held = self.fitting.get(key)
        if held is None:
            if len(self.fitting) > KEPT_PAIRS:
                self.fitting.clear()
            held = self.fitting[key] = bool(self.fits(np.array([left]), np.array([right]))[0])
        return held

    def long_counts(self, piece: bytes) -> np.ndarray:
        """`by_bytes` of one long piece: the tokens that begin at each byte are looked up for BLOCK bytes at
        once, and the pass over them does a few steps a byte, whatever the piece's length."""
        n, block = len(piece), 1 << 15
        text = np.frombuffer(piece, np.uint8).astype(np.int64)
        last, count = np.full(n + 1, -1, np.int32), np.zeros(n + 1, np.int32)
        ends, made = last.tolist(), count.tolist()
        for begin in range(0, n, block):
            start = np.arange(begin, min(n, begin + block))
            node, found = np.zeros(len(start), np.int64), []
            for size in range(1, self.longest + 1):
                inside = start + size <= n
                start, node = start[inside], node[inside]
                node = self.child[node << 8 | text[start + size - 1]].astype(np.int64)
                start, node = start[node >= 0], node[node >= 0]
                if not len(start):
                    break
                token = self.made[node]
                take = token >= 0
                found.append((start[take], np.full(int(take.sum()), size), token[take]))
            at, size, token = map(np.concatenate, zip(*found, strict=True))
            order = np.lexsort((size, at))
            for j, t, i in zip(at[order].tolist(), token[order].tolist(), (at + size)[order].tolist(), strict=True):
                if ends[i] < 0 and (ends[j] >= 0 or not j) and (self.fit(ends[j], t) if j else self.single[t]):
                    ends[i], made[i] = t, made[j] + 1
        return np.array(made, np.int32)

    def pieces(self, todo: list[str]) -> dict[str, bytes]:
        """For each piece, what its characters add to the number of tokens."""
        out, by_size = {}, {}
        for p in todo:
            b = p.encode("utf-8", "surrogatepass")
            by_size.setdefault(max(3, len(b).bit_length()) if len(b) < 64 else len(b), []).append((p, b))
        for size, rows in by_size.items():
            step = max(1, 20_000 * LONG_PIECE // max(size, LONG_PIECE))
            for at in range(0, len(rows), step):
                part = rows[at : at + step]
                n = np.array([len(b) for _, b in part])
                held = [b for _, b in part]
                count = (np.stack([self.long_counts(b) for b in held]) if size >= LONG_PIECE else self.by_bytes(held))[:, 1:]
                within = np.arange(count.shape[1]) < n[:, None]
                text, full = np.frombuffer(b"".join(b for _, b in part), np.uint8), count[within]
                last = np.append((text[1:] & 0xC0) != 0x80, True)  # a character's last byte
                held, chars = full[last], np.cumsum([len(p) for p, _ in part])
                steps = np.diff(held, prepend=0)
                steps[chars[:-1]] = held[chars[:-1]]
                raw, cuts = steps.astype("<i2").tobytes(), [0, *(2 * chars).tolist()]
                out.update(zip((p for p, _ in part), (raw[i:j] for i, j in zip(cuts, cuts[1:])), strict=False))
        return out

    def work(self, todo: list[str]) -> list[bytes]:
        parts = list(map(PIECES.findall, todo))
        steps = self.pieces(list({p for x in parts for p in x}))
        out = [b"".join(map(steps.__getitem__, x)) for x in parts]
        for k, (unit, x) in enumerate(zip(todo, parts, strict=True)):
            if "'" in unit or len(x) > 1 and _RUN.search(unit):
                out[k] = self.tangled(unit, x, out[k])
        return out

    def tangled(self, unit: str, parts: list[str], steps: bytes) -> bytes:
        """The steps of a unit where a cut may change how the text before it is split: about
        apostrophes and runs of white space, from one piece before the cut on."""
        count = np.cumsum(np.frombuffer(steps, "<i2").astype(np.int64))
        starts = np.cumsum([0, *map(len, parts)])
        total = lambda i: int(count[starts[i] - 1]) if i else 0
        odd = {x for i, p in enumerate(parts) if "'" in p or p.isspace() and i + 1 < len(parts) for x in (i, i + 1) if x < len(parts)}
        cuts: dict[int, tuple[int, list[str]]] = {}
        for k in sorted(odd):
            back = max(0, k - 1)
            # white space of a long run: only the cut after its last character is another piece
            first = starts[k] + 1 if not (parts[k].isspace() and k + 1 < len(parts)) or k and parts[k - 1].isspace() else starts[k + 1]
            for j in range(first, min(starts[k + 1], starts[k] + 8) + 1 if not parts[k].isspace() else starts[k + 1] + 1):
                cuts[j] = (total(back), PIECES.findall(unit[starts[back] : j]))
        known = self.pieces(list({p for _, x in cuts.values() for p in x}))
        held = {p: int(np.frombuffer(b, "<i2").astype(np.int64).sum()) for p, b in known.items()}
        for j, (base, x) in cuts.items():
            count[j - 1] = base + sum(map(held.__getitem__, x))
        return np.diff(count, prepend=0).astype("<i2").tobytes()

    def marked(self, text: str) -> bytes:
        out, at = [], 0
        for m in self.special.finditer(text):
            before = np.frombuffer(self.plain(text[at : m.start()]), "<i2").astype(int).sum()
            open_ = np.frombuffer(self.plain(text[at : m.end() - 1]), "<i2")
            out += [open_.tobytes(), np.array([before + 1 - open_.astype(int).sum()], "<i2").tobytes()]
            at = m.end()
        return b"".join([*out, self.plain(text[at:])])


@lru_cache(maxsize=2)
def library_ids(path: str) -> LibraryIds:
    return LibraryIds(path)


@lru_cache(maxsize=2)
def prefix_counts(path: str) -> PrefixCounts:
    return PrefixCounts(path)
