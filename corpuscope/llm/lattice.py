"""Segmentation lattices over a fixed public subword vocabulary.

A word is written as a boundary mark plus its characters; its lattice has an edge for
every vocabulary piece that matches a substring. A character outside the vocabulary
becomes its UTF-8 bytes, one byte piece each, so every word has a path. All
recursions are in log space and run over whole batches of words at once.
"""

from __future__ import annotations

import os

import numpy as np

VOCABULARY = "piece_bpe_32k.model"
MARK = "▁"
# Byte pieces stand at these code points inside a lattice; real characters of this
# private range are spelt in bytes like any other unknown character.
_BYTES = 0x10FE00
_CODES = 0x110000
# Edges handled at once; bounds a worker's memory.
EDGE_BLOCK = 400_000


class Pieces:
    """The vocabulary: piece text -> index, and the order in which it was built."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = model.get_piece_size()
        self.index: dict[str, int] = {}
        self.rank = np.full(self.size, -1.0)
        for i in range(self.size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.index[chr(_BYTES + int(piece[1:-1], 16))] = i
                self.rank[i] = self.size
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)) and piece:
                # Scores of the file are minus the piece's rank; the mark itself and its
                # runs carry none and come last.
                self.index[piece] = i
                self.rank[i] = min(-model.get_score(i), self.size)
        # A trie of the pieces: node and character -> node, the root being 0. Pieces of the
        # nodes (-1 if none), and whether longer ones begin there.
        stems = {p[:k] for p in self.index for k in range(1, len(p))}
        number = {s: i for i, s in enumerate(["", *stems.union(self.index)])}
        steps = sorted((number[s[:-1]] * _CODES + ord(s[-1]), i) for s, i in number.items() if s)
        self.steps, self.nodes = np.array(steps, np.int64).reshape(-1, 2).T.copy()
        self.piece_of = np.array([self.index.get(s, -1) for s in number], np.int64)
        self.grows = np.array([s in stems for s in number])
        self.known = frozenset(p for p in self.index if len(p) == 1 and ord(p) < _BYTES)

    def prior(self) -> np.ndarray:
        """Zipf weights of the vocabulary's own scores: 1 / (rank + 1), summing to 1."""
        weights = np.where(self.rank >= 0, 1.0 / (np.maximum(self.rank, 0.0) + 1.0), 0.0)
        return weights / weights.sum()

    def spell(self, word: str) -> str:
        if self.known.issuperset(word):
            return MARK + word
        spelt = [c if c in self.known else "".join(chr(_BYTES + b) for b in c.encode("utf-8")) for c in word]
        return MARK + "".join(spelt)


_PIECES: dict[str, Pieces] = {}


def pieces(vocabulary: str = VOCABULARY) -> Pieces:
    """The vocabulary of a file, or of a name in the public tokenizers."""
    if vocabulary not in _PIECES:
        path = vocabulary
        if not os.path.isabs(path):
            import public_tokenizers

            path = public_tokenizers.path(vocabulary)
        _PIECES[vocabulary] = Pieces(path)
    return _PIECES[vocabulary]


class Lattice:
    """The edges of a batch of words, ordered by end position, then word."""

    def __init__(self, vocab: Pieces, words: list[str]):
        texts = [vocab.spell(word) for word in words]
        self.n_words = len(words)
        self.lengths = np.array([len(text) for text in texts], np.int64)
        # One node per position of each word, laid out word after word.
        self.base = np.concatenate([[0], np.cumsum(self.lengths + 1)])
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        owner = np.repeat(np.arange(self.n_words), self.lengths)
        stops = np.cumsum(self.lengths)
        # All starts go down the trie together, a character at a time.
        at, node = np.arange(len(codes)), np.zeros(len(codes), np.int64)
        found, n = [np.empty((3, 0), np.int64)], 0
        while len(at):
            step = node * _CODES + codes[at + n]
            place = np.minimum(np.searchsorted(vocab.steps, step), len(vocab.steps) - 1)
            hit = vocab.steps[place] == step
            at, node, n = at[hit], vocab.nodes[place[hit]], n + 1
            piece = vocab.piece_of[node]
            whole = piece >= 0
            found.append(np.stack([at[whole], np.full(int(whole.sum()), n), piece[whole]]))
            on = vocab.grows[node] & (at + n < stops[owner[at]])
            at, node = at[on], node[on]
        at, size, self.piece = np.concatenate(found, axis=1)
        # By word, start and end.
        order = np.argsort(at * (n + 1) + size, kind="stable")
        at, size, self.piece = at[order], size[order], self.piece[order]
        self.word = owner[at]
        self.start = at - (stops - self.lengths)[self.word]
        self.end = self.start + size

    def _steps(self, near: np.ndarray, far: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Edges by ``near`` position and word: (edge order, first edge of each node)."""
        width = int(self.lengths.max(initial=0)) + 1
        key = near * self.n_words + self.word
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        first = np.flatnonzero(np.r_[True, sorted_key[1:] != sorted_key[:-1]]) if len(order) else np.empty(0, np.int64)
        level = sorted_key[first] // max(self.n_words, 1)
        cuts = np.searchsorted(level, np.arange(width + 1))
        steps = []
        for k in range(width):
            a, b = cuts[k], cuts[k + 1]
            if a < b:
                lo, hi = first[a], first[b] if b < len(first) else len(order)
                steps.append((order[lo:hi], first[a:b] - lo))
        return steps

    def _sweep(self, values: np.ndarray, scores: np.ndarray, steps, into: np.ndarray, out_of: np.ndarray) -> None:
        for edges, firsts in steps:
            terms = values[out_of[edges]] + scores[edges]
            top = np.maximum.reduceat(terms, firsts, axis=0)
            sizes = np.diff(np.r_[firsts, len(edges)])
            terms -= np.repeat(top, sizes, axis=0)
            np.exp(terms, out=terms)
            values[into[edges[firsts]]] = top + np.log(np.add.reduceat(terms, firsts, axis=0))

    def forward(self, log_p: np.ndarray) -> np.ndarray:
        """Log of the summed probability of all segmentations: (words, models).

        ``log_p`` is (pieces, models).
        """
        values = self._forward(log_p)
        return values[self.base[1:] - 1]

    def _forward(self, log_p: np.ndarray) -> np.ndarray:
        nodes = self.base[:-1][self.word]
        into, out_of = nodes + self.end, nodes + self.start
        values = np.full((int(self.base[-1]), log_p.shape[1]), -np.inf)
        values[self.base[:-1]] = 0.0
        self._sweep(values, log_p[self.piece], self._steps(self.end, self.start), into, out_of)
        return values

    def expected(self, log_p: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, float]:
        """Expected uses of each piece in ``counts`` occurrences of the words (forward
        and backward pass), and the summed log likelihood. One model."""
        nodes = self.base[:-1][self.word]
        into, out_of = nodes + self.end, nodes + self.start
        ahead = self._forward(log_p)
        behind = np.full((int(self.base[-1]), 1), -np.inf)
        behind[self.base[1:] - 1] = 0.0
        # Starts are taken from the last to the first.
        back = self.lengths[self.word] - self.start
        self._sweep(behind, log_p[self.piece], self._steps(back, self.end), out_of, into)
        total = ahead[self.base[1:] - 1, 0]
        weight = np.exp(ahead[out_of, 0] + log_p[self.piece, 0] + behind[into, 0] - total[self.word])
        uses = np.bincount(self.piece, weights=weight * counts[self.word], minlength=size)
        return uses, float(total @ counts)


def in_blocks(words: list, limit: int = EDGE_BLOCK // 16):
    """Cuts a list of words so that no block has many more than ``limit`` characters."""
    block, chars = [], 0
    # Words of like length together: one long word does not stretch a block of short ones.
    for word in sorted(words, key=len):
        if block and chars + len(word) > limit:
            yield block
            block, chars = [], 0
        block.append(word)
        chars += len(word) + 1
    if block:
        yield block


def word_scores(vocab: Pieces, words: list[bytes], log_p: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """Log marginal probability of each UTF-8 word: (words in the order used, scores)."""
    order, found = [], []
    for block in in_blocks(words):
        order += block
        found.append(Lattice(vocab, [w.decode("utf-8") for w in block]).forward(log_p))
    return order, np.concatenate(found) if found else np.empty((0, log_p.shape[1]))


class Memo:
    """Word -> row of scores, filled a batch at a time; starts anew when full."""

    def __init__(self, vocab: Pieces, log_p: np.ndarray, fold=lambda w: w, most: int = 400_000):
        self.vocab, self.log_p, self.fold, self.most = vocab, log_p, fold, most
        self.rows: dict[bytes, int] = {}
        self.chars = 0
        self.scores = np.empty((0, log_p.shape[1]))

    def lookup(self, words: list[bytes]) -> np.ndarray:
        """Scores of the words of a batch, row for row."""
        rows = self.rows
        missing = set(words).difference(rows)
        if missing:
            if len(rows) + len(missing) > self.most or self.chars > 32 * self.most:
                rows.clear()
                self.chars, self.scores = 0, self.scores[:0]
                missing = set(words)
            self.chars += sum(map(len, missing))
            pairs = {w: self.fold(w) for w in missing}
            order, found = word_scores(self.vocab, list(set(pairs.values())), self.log_p)
            at = {w: i for i, w in enumerate(order)}
            base = len(self.scores)
            self.scores = np.concatenate([self.scores, found])
            for w, folded in pairs.items():
                rows[w] = base + at[folded]
        picked = np.fromiter(map(rows.__getitem__, words), np.int64, len(words))
        return self.scores[picked]


def fit_counts(uses: np.ndarray, prior: np.ndarray, strength: float) -> np.ndarray:
    """Log piece probabilities from expected uses and the vocabulary's own weights.

    Every usable piece keeps some probability; unusable ones get none.
    """
    weights = uses + strength * prior
    with np.errstate(divide="ignore"):
        return np.log(weights / weights.sum())
