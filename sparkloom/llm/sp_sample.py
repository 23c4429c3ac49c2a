"""SentencePiece encoding by Gumbel top-k: distinct sampled segmentations without replacement, and decoding.

The lattice of a text has an edge for each vocabulary piece and, where a character is no piece, one for each
of its bytes. Pieces don't cross the start of a word, so lattices are built once for each distinct word of a
chunk, all words of the chunk together in numpy. Exact backward sums beta make every node's location (the log
probability of all segmentations through it) known; a node's perturbed value is the greatest perturbed log
probability below it. The A-star search keeps, for each text, the sets of segmentations not yet emitted: at
each node of an emitted path the edges not taken, with a Gumbel truncated by the node's own value. As the
bound is exact, each greatest entry leads to the next best segmentation without a detour.

The k-th next entry gives the threshold kappa, and a sample's inclusion score is log P(perturbed > kappa).
Random numbers are a hash of the row key, the path, the word's place and the step, so a row's samples do not
depend on partitions or neighbours.

The model is a BPE vocabulary, whose scores are ranks; a piece of rank r weighs -alpha * ln(r + 2). A model
with other scores uses alpha times these.

Defined cases: a null or empty text has no piece and one segmentation; a text with fewer than k segmentations
emits all, with inclusion score 0; a literal U+2581 is encoded as bytes, so decoding returns every text as it
was; equal keys get equal samples of equal texts, so repeated rows give repeated rows, and a null key is that of -1; of equal
perturbed scores the search keeps the one it met first, which is the same in every run; a text longer than CHUNK is a chunk of
its own, at memory in proportion to its bytes; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import functools
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import vectext as V
from .base import spread, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE_PIECE = "▁".encode()
#: Stand-ins for the bytes of a literal U+2581; no UTF-8 text has them.
LITERAL = bytes((0xF9, 0xFA, 0xFB))
TOP = 2
ALPHA = 1.0
#: Bytes of text whose lattices are searched together.
CHUNK = 3 << 19


class Vocabulary:
    """Pieces as a trie over bytes: next[node, byte], and the piece that ends at a node."""

    def __init__(self, path: str, alpha: float):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        scores = np.array([sp.get_score(i) for i in range(n)])
        ranked = bool(np.all(scores == np.round(scores)))
        weight = -alpha * np.log(2 - np.minimum(scores, 0)) if ranked else alpha * scores
        self.bytes: list[bytes] = [b""] * n
        self.byte_id = np.full(256, sp.unk_id(), np.int32)
        step: list[dict[int, int]] = [{}]
        ends: dict[int, int] = {}
        for i in range(n):
            if sp.is_byte(i):
                value = int(sp.id_to_piece(i)[3:5], 16)
                self.bytes[i] = bytes((value,))
                self.byte_id[value] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                piece = self.bytes[i] = sp.id_to_piece(i).encode()
                node = 0
                for b in piece:
                    new = step[node].get(b)
                    if new is None:
                        new = step[node][b] = len(step)
                        step.append({})
                    node = new
                ends[node] = i
        for own, b in zip(LITERAL, SPACE_PIECE):
            self.byte_id[own] = self.byte_id[b]
        self.next = np.zeros((len(step), 256), np.uint16 if len(step) < 1 << 16 else np.int32)
        for node, x in enumerate(step):
            self.next[node, list(x)] = list(x.values())
        self.piece = np.full(len(step), -1, np.int32)
        self.piece[list(ends)] = list(ends.values())
        self.weight = weight.astype(np.float64)
        self.byte_weight = float(weight.min()) if ranked else float(weight.min() - 10)
        self.pool = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.length = np.array([len(b) for b in self.bytes], np.int64)
        self.begin = np.cumsum(self.length) - self.length

    def decode(self, ids) -> str:
        """The text of pieces."""
        raw = b"".join(self.bytes[i] if self.length[i] > 1 or i not in self._byte_ids else b"\0" + self.bytes[i] for i in ids)
        out = bytearray()
        j = 0
        while j < len(raw):  # a byte piece is literal, so its E2 96 81 is no blank
            if raw[j] == 0:
                out.append(raw[j + 1])
                j += 2
            elif raw.startswith(SPACE_PIECE, j):
                out += b" "
                j += 3
            else:
                out.append(raw[j])
                j += 1
        return bytes(out)[1:].decode("utf-8", "replace")

    @functools.cached_property
    def _byte_ids(self) -> set[int]:
        return set(self.byte_id.tolist())


@functools.lru_cache(maxsize=4)
def vocabulary(path: str, alpha: float) -> Vocabulary:
    return Vocabulary(path, alpha)


def normalized(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes with a blank piece before each text and for each blank, offsets, and marks of their first bytes."""
    if len(data) > 2:
        hit = np.flatnonzero((data[:-2] == 0xE2) & (data[1:-1] == 0x96) & (data[2:] == 0x81))
        if len(hit):
            data = data.copy()
            for j in range(3):
                data[hit + j] = LITERAL[j]
    blank = data == 32
    full = np.diff(offs) > 0
    wide = 1 + 2 * blank.astype(np.int64)
    upto = np.concatenate(([0], np.cumsum(wide)))
    shift = 3 * np.cumsum(full)
    new = upto[offs] + np.concatenate(([0], shift))
    out = np.empty(int(new[-1]), np.uint8)
    at = upto[:-1] + np.repeat(shift, np.diff(offs))
    out[at] = data
    marks = np.concatenate((at[blank], new[:-1][full]))
    for j in range(3):
        out[marks + j] = SPACE_PIECE[j]
    first = np.zeros(len(out), bool)
    first[marks] = True
    return out, new, first


class Lattices:
    """Lattices of distinct words: nodes are byte places, edges sorted by their start."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, v: Vocabulary):
        sizes = ends - starts
        self.word_begin = np.cumsum(sizes + 1) - (sizes + 1)  # one more node for each word's end
        n = int((sizes + 1).sum())
        word = np.repeat(np.arange(len(sizes)), sizes + 1)
        inside = np.arange(n) - self.word_begin[word]
        live = inside < sizes[word]
        text = np.zeros(n, np.uint8)
        text[live] = data[starts[word[live]] + inside[live]]
        left = sizes[word] - inside  # bytes to the word's end
        at, node, depth = np.flatnonzero(live), np.zeros(int(live.sum()), v.next.dtype), 0
        parts = []
        while len(at):
            node = v.next[node, text[at + depth]]
            depth += 1
            ok = node > 0
            at, node = at[ok], node[ok]
            piece = v.piece[node]
            hit = piece >= 0
            parts.append((at[hit], np.full(int(hit.sum()), depth), piece[hit]))
            ok = left[at] > depth
            at, node = at[ok], node[ok]
        # Bytes: where no piece is a whole character that starts here, and inside such characters.
        lead = np.ones(256, np.int64)
        lead[0xC2:0xE0], lead[0xE0:0xF0], lead[0xF0:0xF5] = 2, 3, 4
        width = np.minimum(lead[text], np.maximum(left, 1))
        known = np.zeros(n, bool)
        for start, size, _ in parts[:4]:
            known[start[size == width[start]]] = True
        poor = np.flatnonzero(live & ((text & 0xC0) != 0x80) & ~known)
        spots = np.repeat(poor, width[poor]) + np.arange(width[poor].sum()) - np.repeat(np.cumsum(width[poor]) - width[poor], width[poor])
        # Edges of a node stand together, long ones first: these are likeliest, so a draw seldom looks further.
        counts = np.bincount(spots, minlength=n)
        for start, _, _ in parts:
            counts[start] += 1
        self.first = np.concatenate(([0], np.cumsum(counts)))
        m = int(self.first[-1])
        free = self.first[1:].copy()
        self.start, self.end, self.piece, weight = np.empty(m, np.int64), np.empty(m, np.int64), np.empty(m, np.int32), np.empty(m)
        for start, size, piece, own in [(spots, 1, v.byte_id[text[spots]], v.byte_weight), *((a, b, c, v.weight[c]) for a, b, c in parts)]:
            free[start] -= 1
            slot = free[start]
            self.start[slot], self.end[slot], self.piece[slot], weight[slot] = start, start + size, piece, own
        # Backward sums, nodes nearest to their word's end first.
        some = np.flatnonzero(counts)
        some = some[np.argsort(left[some].astype(np.uint16) if left.max(initial=0) < 65536 else left[some], kind="stable")]
        sizes = counts[some]
        firsts = np.cumsum(sizes) - sizes
        order = np.repeat(self.first[some] - firsts, sizes) + np.arange(m)
        by_level, end = weight[order], self.end[order]
        levels = np.searchsorted(left[some], np.arange(1, int(left.max(initial=0)) + 2))
        beta = np.where(live, -np.inf, 0.0)
        for a, b in zip(levels[:-1].tolist(), levels[1:].tolist()):
            if a < b:
                lo, hi = firsts[a], firsts[b - 1] + sizes[b - 1]
                x = by_level[lo:hi] + beta[end[lo:hi]]
                cuts = firsts[a:b] - lo
                top = np.maximum.reduceat(x, cuts)
                beta[some[a:b]] = top + np.log(np.add.reduceat(np.exp(x - np.repeat(top, sizes[a:b])), cuts))
        self.log_p = weight + beta[self.end] - beta[self.start]
        total = np.concatenate(([0.0], np.cumsum(np.exp(self.log_p))))
        self.cdf = total[1:] - total[self.first[self.start]]
        self.cdf[self.first[1:][counts > 0] - 1] = 2.0  # the last edge takes what rounding leaves
        self.is_end = ~live

    def draw(self, node: np.ndarray, u: np.ndarray) -> np.ndarray:
        """An edge of each node by its probability; u is in [0, 1)."""
        e = self.first[node]
        over = np.flatnonzero(u >= self.cdf[e])
        while len(over):
            e[over] += 1
            over = over[u[over] >= self.cdf[e[over]]]
        return e


def _uniform(x: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) of 64-bit hashes."""
    return ((V.mix(x) >> np.uint64(12)).astype(np.float64) + 0.5) / 2.0**52


def _truncated(location: np.ndarray, bound: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbel values of locations, given that they are below bounds."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(np.isneginf(location), -np.inf, location - np.logaddexp(location - bound, np.log(-np.log(u))))


def _log1m(p: np.ndarray) -> np.ndarray:
    """log(1 - p), with what rounding leaves of a certain edge taken as none."""
    left = 1 - p
    with np.errstate(divide="ignore"):
        return np.where(left > 1e-12, np.log(np.maximum(left, 1e-300)), -np.inf)


class Chunk:
    """The search over all texts of a chunk at once."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, keys: np.ndarray, v: Vocabulary):
        self.v, self.keys, self.rows = v, keys, len(offs) - 1
        self.text, self.offs, blank = normalized(data, offs)
        text = self.text
        start = blank.copy()
        start[3:] &= ~blank[:-3]
        newline = text == 10
        start |= newline
        start[1:] |= newline[:-1]
        start[self.offs[:-1][np.diff(self.offs) > 0]] = True
        self.begin = np.flatnonzero(start)
        ends = np.append(self.begin[1:], len(text))
        self.upto = np.searchsorted(self.begin, self.offs)
        h = V.span_hashes(V.prefix_sums(text), self.begin, ends) if len(text) else np.zeros(0, np.uint64)
        _, at, self.kind = np.unique(h, return_index=True, return_inverse=True)
        self.lat = Lattices(text, self.begin[at], ends[at], v)
        self.doc = np.repeat(np.arange(self.rows), np.diff(self.upto))
        self.place = np.arange(len(self.begin)) - self.upto[self.doc]

    def walk(self, docs: np.ndarray, from_word: np.ndarray, node: np.ndarray, path: int) -> tuple[np.ndarray, np.ndarray]:
        """Draws the words from from_word to each doc's end; the first of them starts at node (-1: its begin).
        Edges in order, and their count for each doc."""
        n = self.upto[docs + 1] - from_word
        word = np.repeat(from_word - (np.cumsum(n) - n), n) + np.arange(n.sum())
        at = self.lat.word_begin[self.kind[word]]
        has = n > 0
        head = (np.cumsum(n) - n)[has]
        own = node[has]
        at[head[own >= 0]] = own[own >= 0]
        seed = self.keys[self.doc[word]] + np.uint64(path) * np.uint64(0x9E3779B97F4A7C15)
        with np.errstate(over="ignore"):
            seed = V.mix(seed + self.place[word].astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
        live, step, parts = np.flatnonzero(~self.lat.is_end[at]), 0, []
        counts = np.zeros(len(word), np.int64)
        while len(live):
            e = self.lat.draw(at[live], _uniform(seed[live] + np.uint64(step)))
            parts.append((live, e))
            counts[live] += 1
            at[live] = self.lat.end[e]
            live = live[~self.lat.is_end[at[live]]]
            step += 1
        begin = np.cumsum(counts) - counts
        out = np.empty(int(counts.sum()), np.int64)
        for s, (live, e) in enumerate(parts):
            out[begin[live] + s] = e
        total = np.concatenate(([0], np.cumsum(counts)))
        edges_upto = total[np.concatenate(([0], np.cumsum(n)))]
        self._words = np.repeat(word, counts)
        return out, edges_upto

    def search(self, k: int):
        """Lists over samples: (docs, edges, edges up to each doc, log probability), and kappa for each doc."""
        lat, docs = self.lat, np.arange(self.rows)
        root = -np.log(-np.log(_uniform(self.keys ^ np.uint64(0xABCDEF))))
        paths, heads = [], [[] for _ in range(self.rows)]  # heads: replaced entries of each doc
        samples = []
        edges, upto = self.walk(docs, self.upto[:-1], np.full(self.rows, -1), 0)
        value = root
        prefix = np.zeros(self.rows)
        before: list = [None] * self.rows
        for i in range(k):
            lp = lat.log_p[edges]
            n = np.diff(upto)
            cum = np.concatenate(([0.0], np.cumsum(lp)))
            own = np.repeat(np.arange(len(docs)), n)
            base = prefix - cum[upto[:-1]]
            seen = cum[:-1] + base[own] if len(own) else np.zeros(0)
            local = np.arange(len(edges)) - upto[own] if len(own) else np.zeros(0, np.int64)
            with np.errstate(over="ignore"):
                u = _uniform(V.mix(self.keys[docs[own]] ^ np.uint64(0x5DEECE66D + i)) + local.astype(np.uint64))
            rest = _truncated(seen + _log1m(np.exp(lp)), value[own], u)
            if i:
                # The first edge of a side path shares its node with the path it left; that entry is below.
                rest[upto[:-1][n > 0]] = -np.inf
            log_prob = prefix + cum[upto[1:]] - cum[upto[:-1]]
            samples.append((docs, edges, upto, log_prob, before))
            paths.append((edges, upto, rest, seen, self._words, {int(d): j for j, d in enumerate(docs)} if i else None))
            if i:
                # Entries (value, path, edge index, taken edges, location before the node) whose edge was taken.
                new = edges[upto[:-1]]
                for j, d in enumerate(docs.tolist()):
                    heads[d][-1][3].append(int(new[j]))
                share = np.exp(lat.log_p[[e for d in docs.tolist() for e in heads[d][-1][3]]])
                sizes = np.array([len(heads[d][-1][3]) for d in docs.tolist()])
                share = np.add.reduceat(share, np.cumsum(sizes) - sizes)
                u = _uniform(self.keys[docs] ^ np.uint64(0x1234567 * (i + 1)))
                left = _truncated(prefix + _log1m(share), value, u)
                for d, g in zip(docs.tolist(), left.tolist()):
                    heads[d][-1] = (g, *heads[d][-1][1:])
            top = np.full(self.rows, -np.inf)
            # The greatest entry of each doc over all paths so far.
            pick: list = [None] * self.rows
            for p, (pe, pu, pr, ps, _, rows) in enumerate(paths):
                idx = np.arange(self.rows) if rows is None else np.fromiter(rows, np.int64, len(rows))
                size = np.diff(pu)
                some = np.flatnonzero(size)
                if not len(some):
                    continue
                best = np.maximum.reduceat(pr, pu[:-1][some])
                for j, g in zip(some[best > top[idx[some]]].tolist(), best[best > top[idx[some]]].tolist()):
                    d = int(idx[j])
                    top[d] = g
                    pick[d] = (p, j)
            for d, hs in enumerate(heads):
                for q, h in enumerate(hs):
                    if h[0] > top[d]:
                        top[d], pick[d] = h[0], (-1, q)
            if i == k - 1:
                break
            docs_new, words, nodes, values, prefixes, befores, forced = [], [], [], [], [], [], []
            draws = _uniform(self.keys ^ np.uint64(0x7654321 * (i + 1))).tolist()
            for d, choice in enumerate(pick):
                if choice is None or np.isneginf(top[d]):
                    continue
                p, j = choice
                if p >= 0:
                    pe, pu, pr, ps, pw, rows = paths[p]
                    x = int(pu[j] + pr[pu[j] : pu[j + 1]].argmax())
                    heads[d].append((top[d], p, x, [int(pe[x])], float(ps[x])))
                    pr[x] = -np.inf
                else:
                    heads[d].append(heads[d].pop(j))
                _, p, x, taken, loc = heads[d][-1]
                pe, pu, pr, ps, pw, rows = paths[p]
                j = d if rows is None else rows[d]
                node = int(lat.start[pe[x]])
                a, b = int(lat.first[node]), int(lat.first[node + 1])
                others = [e for e in range(a, b) if e not in taken]
                shares = [math.exp(lat.log_p[e]) for e in others]
                left, e = draws[d] * sum(shares), others[-1]
                for o, w in zip(others, shares):
                    left -= w
                    if left < 0:
                        e = o
                        break
                docs_new.append(d)
                words.append(int(pw[x]))
                nodes.append(int(lat.end[e]))
                values.append(top[d])
                prefixes.append(loc)
                befores.append((p, j, x))
                forced.append(e)
            docs = np.array(docs_new, np.int64)
            if not len(docs):
                break
            value, prefix, before = np.array(values), np.array(prefixes), befores
            tail, tu = self.walk(docs, np.array(words, np.int64), np.array(nodes, np.int64), i + 1)
            # Put the chosen edge before each tail.
            upto = tu + np.arange(len(docs) + 1)
            edges = np.insert(tail, tu[:-1], forced)
            self._words = np.insert(self._words, tu[:-1], words)
        return samples, paths, top

    def full(self, samples, paths, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Docs, piece ids and their bounds of sample i, with what a side path shares with the one it left."""
        docs, edges, upto, _, before = samples[i]
        if not i:
            return docs, self.lat.piece[edges], upto
        parts, sizes = [], []
        for j in range(len(docs)):
            head, at = [], before[j]
            while at:
                p, row, x = at
                head.append(paths[p][0][paths[p][1][row] : x])
                at = samples[p][4][row] if p else None
            own = np.concatenate([*reversed(head), edges[upto[j] : upto[j + 1]]])
            parts.append(own)
            sizes.append(len(own))
        return docs, self.lat.piece[np.concatenate(parts)], np.concatenate(([0], np.cumsum(sizes)))

    def decoded(self, docs: np.ndarray, ids: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """Whether the bytes of the pieces are the normalized text of each doc."""
        v = self.v
        size = v.length[ids]
        total = np.concatenate(([0], np.cumsum(size)))
        raw = v.pool[np.repeat(v.begin[ids] - total[:-1], size) + np.arange(total[-1])]
        want = self.text.copy()
        for a, b in zip(LITERAL, SPACE_PIECE):
            want[want == a] = b
        length = np.diff(self.offs)[docs]
        same = total[upto[1:]] - total[upto[:-1]] == length
        if same.all():
            at = np.repeat(self.offs[docs] - (np.cumsum(length) - length), length) + np.arange(length.sum())
            bad = np.concatenate(([0], np.cumsum(raw != want[at])))
            cut = np.concatenate(([0], np.cumsum(length)))
            same = bad[cut[1:]] == bad[cut[:-1]]
        return same


def log_inclusion(log_prob: np.ndarray, kappa: np.ndarray) -> np.ndarray:
    """log(1 - exp(-exp(log_prob - kappa))), 0 where kappa is minus infinity."""
    with np.errstate(divide="ignore", over="ignore", invalid="ignore"):
        x = np.minimum(log_prob - kappa, 700)
        return np.where(np.isneginf(kappa), 0.0, np.where(x < -30, x, np.log(-np.expm1(-np.exp(x)))))


def sample_chunk(data: np.ndarray, offs: np.ndarray, keys: np.ndarray, v: Vocabulary, k: int):
    """For each row, its samples: (ids, log probability, log inclusion score, decodes to the text)."""
    chunk = Chunk(data, offs, keys, v)
    samples, paths, kappa = chunk.search(k)
    out: list[list[tuple]] = [[] for _ in range(chunk.rows)]
    for i in range(len(samples)):
        docs, ids, upto = chunk.full(samples, paths, i)
        lp, ok = samples[i][3], chunk.decoded(docs, ids, upto)
        inc = log_inclusion(lp, kappa[docs])
        ids = ids.astype(np.int32)
        for j, d in enumerate(docs.tolist()):
            out[d].append((ids[upto[j] : upto[j + 1]], float(lp[j]), float(inc[j]), bool(ok[j])))
    return out


def row_keys(ids: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return V.mix(ids.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


def encode(docs: DataFrame, k: int = TOP, model: str = MODEL, alpha: float = ALPHA, seed: int = 0, with_ids: bool = False) -> DataFrame:
    """For each row its distinct samples, best perturbed first: piece counts, log probabilities, log inclusion
    scores, CRC-32 of the ids (as little-endian 32-bit numbers), whether all decode to the text, and on
    request the ids."""
    schema = T.StructType([docs.schema["doc_id"]])
    names = {"n_samples": T.LongType(), "n_pieces": T.ArrayType(T.LongType()), "log_prob": T.ArrayType(T.DoubleType()), "log_inclusion": T.ArrayType(T.DoubleType()), "ids_crc32": T.ArrayType(T.LongType()), "round_trip": T.BooleanType()}
    if with_ids:
        names["ids"] = T.ArrayType(T.ArrayType(T.IntegerType()))
    for name, kind in names.items():
        schema = schema.add(name, kind)

    def run(batches):
        v = vocabulary(model, alpha)
        for batch in batches:
            key = batch.column("doc_id").fill_null(-1).to_numpy(zero_copy_only=False)
            for a, b, data, offs in V.chunks(batch.column("text"), CHUNK):
                got = sample_chunk(data, offs, row_keys(key[a:b], seed), v, k)
                cols = [
                    batch.column("doc_id").slice(a, b - a),
                    pa.array([len(s) for s in got], pa.int64()),
                    pa.array([[len(x[0]) for x in s] for s in got], pa.list_(pa.int64())),
                    pa.array([[round(x[1], 4) for x in s] for s in got], pa.list_(pa.float64())),
                    pa.array([[round(x[2], 4) for x in s] for s in got], pa.list_(pa.float64())),
                    pa.array([[zlib.crc32(x[0].tobytes()) for x in s] for s in got], pa.list_(pa.int64())),
                    pa.array([all(x[3] for x in s) for s in got], pa.bool_()),
                ]
                if with_ids:
                    cols.append(pa.array([[x[0] for x in s] for s in got], pa.list_(pa.list_(pa.int32()))))
                yield pa.RecordBatch.from_arrays(cols, schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def op5_sp_sample(spark, sf_dir: str) -> DataFrame:
    return encode(spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id"))
