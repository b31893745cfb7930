"""A block-max inverted index over a bounded set of weighted items."""

from __future__ import annotations

from functools import cached_property

import numpy as np


class BlockMaxIndex:
    """Postings (term, item, weight) in blocks of consecutive items; each (term, block) keeps its largest weight.

    A query is a set of distinct term numbers with weights. ``bounds`` gives, for every block, a score that no
    item in it exceeds, so whole blocks are skipped; ``scores`` gives the exact scores in one block.
    """

    def __init__(self, terms, items, weights, n_terms: int, n_items: int, block: int = 32):
        order = np.lexsort((items, terms))
        terms, self.items = np.asarray(terms, "i8")[order], np.asarray(items, "i8")[order]
        self.weights = np.asarray(weights, "f8")[order]
        self.block, self.n_items = block, n_items
        self.n_blocks = max(1, -(-n_items // block))
        cell = terms * self.n_blocks + self.items // block
        self.starts = np.searchsorted(cell, np.arange(n_terms * self.n_blocks + 1))
        self.max = np.zeros(n_terms * self.n_blocks)
        np.maximum.at(self.max, cell, self.weights)
        self.max = self.max.reshape(n_terms, self.n_blocks)

    def bounds(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        return weights @ self.max[terms]

    def scores(self, block: int, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        cells = terms * self.n_blocks + block
        first, last = self.starts[cells], self.starts[cells + 1]
        sizes = last - first
        places = np.repeat(first - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        width = min(self.block, self.n_items - block * self.block)
        return np.bincount(
            self.items[places] - block * self.block, np.repeat(weights, sizes) * self.weights[places], width
        )

    @cached_property
    def near(self) -> np.ndarray:
        """``max`` in half the bytes, never less; made where it is used, so it does not travel."""
        return np.where(self.max > 0, np.nextafter(self.max.astype("f4"), np.float32(np.inf)), np.float32(0))

    def passing(self, terms: np.ndarray, first: np.ndarray, last: np.ndarray, least: float):
        """(query, item, score) of all scores of ``least`` or more. Query i asks terms[first[i]:last[i]], each with
        weight 1; queries follow one another. A block is scored only for queries whose bound reaches ``least``."""
        # Bounds are sums of floats: lowered by more than the additions can lose.
        enough = least * (1 - (last - first).max(initial=1) * 2.0**-22)
        query, block = np.nonzero(np.add.reduceat(self.near[terms], first, axis=0) >= enough)
        width = (last - first)[query]
        at = np.repeat(np.arange(len(query)), width)
        cells = terms[np.repeat(first[query] - np.cumsum(width) + width, width) + np.arange(len(at))] * self.n_blocks + block[at]
        begin = self.starts[cells]
        sizes = self.starts[cells + 1] - begin
        places = np.repeat(begin - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        # Scores are added in the order of the terms, as in ``scores``.
        slot = np.repeat(at * self.block - block[at] * self.block, sizes) + self.items[places]
        score = np.bincount(slot, self.weights[places], len(query) * self.block)
        found = np.flatnonzero(score >= least)
        pair = found // self.block
        return query[pair], block[pair] * self.block + found % self.block, score[found]
