"""Seating of a two-level hierarchical Pitman-Yor model, vectorised.

Every context has a restaurant; its customers are the words that follow the
context, its tables serve words drawn from the shared parent restaurant. The
tables of all contexts are the parent's customers; its own tables draw from a
uniform base over the vocabulary and one more place for unknown words.

The state is the number of tables t of each (context, word) with c customers.
One Gibbs step draws t anew given all else: up to ``EXACT`` customers from its
full conditional, S_d(c, t) * (theta + d * T)_t * P(word)**t with generalised
Stirling numbers S_d, which sums over all seatings; beyond that by seating
the c customers in turn, in runs over which the chance of a new table is held.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

EXACT = 32


@dataclass(frozen=True)
class Prior:
    """Discounts and strengths of the context restaurants and of the parent."""

    discount: float = 0.75
    strength: float = 1.0
    root_discount: float = 0.6
    root_strength: float = 10.0


def log_stirling(discount: float, top: int = EXACT) -> np.ndarray:
    """log S_d(c, t) for c, t up to ``top``: S(c + 1, t) = S(c, t - 1) + (c - t * d) * S(c, t)."""
    out = np.full((top + 1, top + 1), -np.inf)
    out[0, 0] = 0.0
    for c in range(top):
        for t in range(1, c + 2):
            stay = np.log(c - t * discount) + out[c, t] if c >= t and c - t * discount > 0 else -np.inf
            out[c + 1, t] = np.logaddexp(out[c, t - 1], stay)
    return out


def draw_tables(
    customers: np.ndarray,
    others: np.ndarray,
    parent: np.ndarray,
    discount: float,
    strength: float,
    rng: np.random.Generator,
    stirling: np.ndarray,
) -> np.ndarray:
    """Tables of each dish, given ``others``, the tables of other dishes in its
    restaurant, and ``parent``, the parent's probability of the dish."""
    out = np.minimum(customers, 1).astype(np.int64)
    small = np.flatnonzero((customers >= 2) & (customers <= EXACT))
    small = small[np.argsort(customers[small], kind="stable")]
    cuts = np.searchsorted(customers[small], np.arange(2, EXACT + 2))
    for c in range(2, EXACT + 1):
        for at in range(cuts[c - 2], cuts[c - 1], 1 << 16):
            rows = small[at : min(at + (1 << 16), cuts[c - 1])]
            steps = strength + discount * (others[rows][:, None] + np.arange(c))
            weight = stirling[c, 1 : c + 1] + np.cumsum(np.log(np.maximum(steps, 1e-12) * parent[rows][:, None]), axis=1)
            # The largest of weight + Gumbel noise is a draw from the normalised weights.
            out[rows] = 1 + np.argmax(weight - np.log(rng.standard_exponential(weight.shape)), axis=1)
    large = np.flatnonzero(customers > EXACT)
    if len(large):
        c, p, rest = customers[large], parent[large], others[large]
        tables, seated = np.ones(len(large)), np.ones(len(large))
        while True:
            todo = np.flatnonzero(seated < c)
            if not len(todo):
                break
            run = np.minimum(np.maximum(1, seated[todo] // 16), c[todo] - seated[todo]).astype(np.int64)
            new = (strength + discount * (rest[todo] + tables[todo])) * p[todo]
            old = seated[todo] - discount * tables[todo]
            tables[todo] += rng.binomial(run, np.clip(new / (new + old), 0.0, 1.0))
            seated[todo] += run
        out[large] = tables.astype(np.int64)
    return out


class Restaurants:
    """The dishes of some words in all contexts, with counts of the training text.

    ``word``, ``context`` and ``count`` are one entry for each different
    (word, context); ``scale`` says how many such sets make up the model,
    so that totals not known yet can be estimated from this set's. Words marked in
    ``spread`` have their contexts dealt over all sets: a set's customers of such a
    word are a part of the word's, and are estimated up like the totals.
    """

    def __init__(
        self, word: np.ndarray, context: np.ndarray, count: np.ndarray, words: int, contexts: int, prior: Prior,
        spread: np.ndarray | None = None,
    ):
        self.spread = np.zeros(words, bool) if spread is None else spread
        self.word, self.context, self.count = word, context, count
        self.words, self.contexts, self.prior = words, contexts, prior
        self.stirling = log_stirling(prior.discount)
        self.root_stirling = log_stirling(prior.root_discount)

    def sample(self, seed: int, scale: float, burn: int, keep: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """``keep`` states after ``burn`` sweeps: tables by entry, the parent's customers and tables by word."""
        prior, rng = self.prior, np.random.default_rng(seed)
        tables = np.minimum(self.count, 1).astype(np.int64)
        known = np.bincount(self.word, minlength=self.words) > 0
        # How many times a word's customers are those seen here, and how many words such as it there are.
        share = np.where(self.spread, scale, 1.0)
        alike = np.where(self.spread, 1.0, scale)
        vocabulary = (known * alike).sum()
        out = []
        for sweep in range(burn + keep):
            customers = np.rint(np.bincount(self.word, tables, self.words) * share)
            in_context = np.bincount(self.context, tables, self.contexts)
            root = np.minimum(customers, 1).astype(np.int64)
            base = np.full(self.words, 1 / (vocabulary + 1))
            if sweep:
                rest = (root_tables * alike).sum() - root_tables * alike
                root = draw_tables(
                    customers.astype(np.int64), rest, base, prior.root_discount, prior.root_strength, rng, self.root_stirling
                )
            root_tables = root
            parent = parent_probability(
                customers, root_tables, (customers * alike).sum(), (root_tables * alike).sum(), vocabulary, prior
            )
            others = (in_context[self.context] - tables) * scale
            tables = draw_tables(self.count, others, parent[self.word], prior.discount, prior.strength, rng, self.stirling)
            if sweep >= burn:
                customers = np.bincount(self.word, tables, self.words).astype(np.int64)
                whole = np.rint(customers * share).astype(np.int64)
                rest = (root_tables * alike).sum() - root_tables * alike
                root_tables = draw_tables(whole, rest, base, prior.root_discount, prior.root_strength, rng, self.root_stirling)
                out.append((tables.copy(), customers, root_tables.copy()))
        return out


def parent_probability(customers, tables, all_customers, all_tables, vocabulary, prior: Prior):
    """The parent's predictive probability of words with these customers and tables."""
    rest = (prior.root_strength + prior.root_discount * all_tables) / (vocabulary + 1)
    return (np.maximum(customers - prior.root_discount * tables, 0) + rest) / (prior.root_strength + all_customers)


def context_probability(count, tables, in_context, context_tables, parent, prior: Prior):
    """The predictive probability of a word with ``count`` customers at ``tables``
    tables of a context that has ``in_context`` customers at ``context_tables``."""
    rest = (prior.strength + prior.discount * context_tables) * parent
    return (np.maximum(count - prior.discount * tables, 0) + rest) / (prior.strength + in_context)
