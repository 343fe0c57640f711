"""Marginal probability of a word over all its segmentations into subword pieces.

The pieces come from an existing vocabulary file. Words are handled in groups of equal
length as matrices of code points: one rolling hash finds every piece at every place,
and the forward (and, for training, backward) recursion runs in log space over the
columns. A code point that no piece covers is spelled with the vocabulary's byte pieces,
so every word has a probability.
"""

from __future__ import annotations

import numpy as np

WORD_START = "▁"
_BASE = np.uint64(0x9E3779B97F4A7C15)
_GROUP_CELLS = 1 << 17        # code points a group holds at most, unless one word has more


def code_points(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)


def prefix_hashes(codes: np.ndarray) -> np.ndarray:
    """(rows, m) code points -> (rows, m + 1) rolling hashes, modulo 2**64."""
    out = np.zeros((codes.shape[0], codes.shape[1] + 1), dtype=np.uint64)
    for j in range(codes.shape[1]):
        out[:, j + 1] = out[:, j] * _BASE + codes[:, j] + np.uint64(1)
    return out


class Lattice:
    def __init__(self, tables: dict, byte_ids: np.ndarray, n_ids: int):
        self.tables, self.byte_ids, self.n_ids = tables, byte_ids, n_ids

    @property
    def state(self) -> tuple:
        """Plain values that make the same lattice again, for a Spark broadcast."""
        return self.tables, self.byte_ids, self.n_ids

    @classmethod
    def of_pieces(cls, pieces: list[str], ids: list[int], byte_ids: list[int], n_ids: int) -> Lattice:
        by_len: dict[int, list[tuple[int, int]]] = {}
        for piece, i in zip(pieces, ids):
            h = prefix_hashes(code_points(piece)[None, :])[0, -1]
            by_len.setdefault(len(piece), []).append((int(h), i))
        tables = {}
        for n, rows in sorted(by_len.items()):
            rows.sort()
            tables[n] = (np.array([r[0] for r in rows], dtype=np.uint64),
                         np.array([r[1] for r in rows], dtype=np.int64))
        return cls(tables, np.array(byte_ids), n_ids)

    def groups(self, words: list[str]):
        """(places, code points incl. the word-start sign) for groups of equally long words."""
        n = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        flat = code_points("".join(words))
        start = np.concatenate([[0], np.cumsum(n)[:-1]]) if len(n) else n
        order = np.argsort(n, kind="stable")
        lo = 0
        while lo < len(order):
            m = int(n[order[lo]])
            hi = int(np.searchsorted(n[order], m, "right"))
            step = max(1, _GROUP_CELLS // (m + 1))
            for a in range(lo, hi, step):
                idx = order[a:min(hi, a + step)]
                codes = np.full((len(idx), m + 1), ord(WORD_START), dtype=np.uint64)
                codes[:, 1:] = flat[start[idx][:, None] + np.arange(m)]
                yield idx, codes
            lo = hi

    def match(self, codes: np.ndarray) -> dict[int, np.ndarray]:
        """For each piece length, the id of the piece that starts at each place, or n_ids."""
        h, found = prefix_hashes(codes), {}
        power = np.ones(1, dtype=np.uint64)
        m = codes.shape[1]
        for n in range(1, min(m, max(self.tables, default=0)) + 1):
            power = power * _BASE
            if n not in self.tables:
                continue
            keys, ids = self.tables[n]
            sub = h[:, n:] - h[:, :-n] * power
            at = np.minimum(np.searchsorted(keys, sub), len(keys) - 1)
            got = np.where(keys[at] == sub, ids[at], self.n_ids)
            if n == 1 or (got < self.n_ids).any():
                found[n] = got
        found.setdefault(1, np.full(codes.shape, self.n_ids))
        return found

    def spelled(self, code: int) -> np.ndarray:
        return self.byte_ids[list(chr(code).encode("utf-8", "surrogatepass"))]

    def scores(self, codes, found, logp) -> dict[int, np.ndarray]:
        ext = np.append(logp, -np.inf)
        out = {n: ext[ids] for n, ids in found.items()}
        bare = found[1] == self.n_ids
        if bare.any():
            kinds, inverse = np.unique(codes[bare], return_inverse=True)
            out[1][bare] = np.array([logp[self.spelled(int(c))].sum() for c in kinds])[inverse]
        return out

    @staticmethod
    def _step(terms: list[np.ndarray]) -> np.ndarray:
        if len(terms) == 1:
            return terms[0]
        t = np.stack(terms)
        top = t.max(axis=0)
        return top + np.log(np.exp(t - top).sum(axis=0))

    def forward(self, scores: dict[int, np.ndarray], m: int) -> np.ndarray:
        rows = scores[1].shape[0]
        alpha = np.zeros((m + 1, rows))
        for j in range(1, m + 1):
            alpha[j] = self._step([alpha[j - n] + s[:, j - n] for n, s in scores.items() if n <= j])
        return alpha

    def log_prob(self, words: list[str], logp: np.ndarray) -> np.ndarray:
        """Natural log of each word's marginal probability."""
        return self.log_probs(words, logp)[0]

    def log_probs(self, words: list[str], *logps: np.ndarray) -> np.ndarray:
        """One row of :meth:`log_prob` for each of ``logps``; pieces are looked up once."""
        out = np.zeros((len(logps), len(words)))
        for idx, codes in self.groups(words):
            found = self.match(codes)
            scores = [self.scores(codes, found, logp) for logp in logps]
            stacked = {n: np.concatenate([s[n] for s in scores]) for n in found}
            out[:, idx] = self.forward(stacked, codes.shape[1])[-1].reshape(len(logps), -1)
        return out

    def expected(self, words: list[str], counts: np.ndarray, logp: np.ndarray) -> np.ndarray:
        """Expected uses of each piece in ``words``, each word weighted by its count."""
        total = np.zeros(self.n_ids + 1)
        for idx, codes in self.groups(words):
            m = codes.shape[1]
            found = self.match(codes)
            s = self.scores(codes, found, logp)
            alpha = self.forward(s, m)
            beta = np.zeros_like(alpha)
            for i in range(m - 1, -1, -1):
                beta[i] = self._step([beta[i + n] + v[:, i] for n, v in s.items() if i + n <= m])
            weight = counts[idx]
            for n, ids in found.items():
                post = np.exp(alpha[:m - n + 1].T + s[n] + beta[n:].T - alpha[-1][:, None]) * weight[:, None]
                total += np.bincount(ids.ravel(), post.ravel(), self.n_ids + 1)
                if n == 1:
                    bare = ids == self.n_ids
                    for c, w in zip(codes[bare], post[bare]):
                        np.add.at(total, self.spelled(int(c)), w)
        return total[:-1]


def load(path: str) -> tuple[Lattice, np.ndarray]:
    """The pieces of a vocabulary file and first log probabilities from its scores, which
    rank the pieces: probability falls with the rank."""
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    byte_ids, pieces, ids, weight = [0] * 256, [], [], np.zeros(n)
    for i in range(n):
        piece = sp.id_to_piece(i)
        if sp.is_byte(i):
            byte_ids[int(piece[1:-1], 16)] = i
            weight[i] = 1e-4
        elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
            pieces.append(piece)
            ids.append(i)
            weight[i] = 1.0 / (200.0 - sp.get_score(i))
    with np.errstate(divide="ignore"):
        return Lattice.of_pieces(pieces, ids, byte_ids, n), np.log(weight / weight.sum())
