"""A backoff automaton over the n-grams of some texts, and its traversal.

States are contexts that training has seen, the root is the empty one. A state's arcs are the
n-grams that continue it, each with the log probability of its last token and the state it leads to:
the longest context that ends there. A token without an arc takes the failure arc, which costs the
backoff weight and leads to the context without its first token; at the root every token has an arc.

Grams are numbered, and the number of a context is that of its state. Every part is an array of one
entry for each distinct gram, so an automaton is as large as the texts it was built for."""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np

SEGMENT = 512        # tokens that one lane of a traversal reads


@dataclass
class Automaton:
    root: int                   # also the number of grams
    start: int                  # state before a text's first token
    order: int
    failure: np.ndarray         # of each state: where its failure arc leads, and its weight
    failure_weight: np.ndarray
    keys: np.ndarray            # sorted arcs, state * (root + 1) + token
    weight: np.ndarray
    leads_to: np.ndarray
    root_weight: np.ndarray     # of each token
    root_leads_to: np.ndarray


def build(at: np.ndarray, deeper: np.ndarray, first: np.ndarray, counts: np.ndarray, start: int,
          n: int, v: int, prior: float) -> Automaton:
    """`at[k]` has the number of the (k + 1)-gram that ends at each token and `deeper[k]` tells where
    there is one; `first` marks first tokens of texts, `counts` has the training count of each gram and
    of `start`, the context of a text's first token. n tokens and v distinct ones were learned from.

        P(w) = (c(w) + 1) / (n + v + 1)        P(w | h) = (c(hw) + prior * P(w | h')) / (c(h) + prior)
    """
    order, root = len(at), len(counts)
    p = (counts + 1) / (n + v + 1)                      # by gram; right for single tokens, others follow
    failure = np.full(root, root)
    keys, grams, ends = [], [], []
    for k in range(1, order):
        gram, where = np.unique(at[k][deeper[k]], return_index=True)
        seen = counts[gram] > 0
        gram, where = gram[seen], np.flatnonzero(deeper[k])[where[seen]]
        shorter = at[k - 1][where]
        context = np.where(first[where], start, at[k - 1][where - 1])
        p[gram] = (counts[gram] + prior * p[shorter]) / (counts[context] + prior)
        failure[gram] = shorter
        keys.append(context * (root + 1) + at[0][where])
        grams.append(gram)
        ends.append(gram if k + 1 < order else shorter)
    nothing = [np.zeros(0, np.int64)]
    keys, grams, ends = (np.concatenate(x or nothing) for x in (keys, grams, ends))
    by_key = np.argsort(keys)
    state = (counts > 0) & (order > 1)
    with np.errstate(divide="ignore"):
        failure_weight = np.log10(prior / (counts + prior))
    return Automaton(root, start if state[start] else root, order, failure, failure_weight, keys[by_key],
                     np.log10(p[grams[by_key]]), ends[by_key], np.log10((counts + 1) / (n + v + 1)),
                     np.where(state, np.arange(root), root))


def _step(model: Automaton, state: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Reads one token in each lane: the states after it and the weights of the arcs taken."""
    weight, after = np.zeros(len(state)), np.empty_like(state)
    open_ = np.arange(len(state))
    while len(open_):
        at_root = state[open_] == model.root
        done = open_[at_root]
        weight[done] += model.root_weight[token[done]]
        after[done] = model.root_leads_to[token[done]]
        open_ = open_[~at_root]
        if not len(open_) or not len(model.keys):
            hit = np.zeros(len(open_), bool)
        else:
            key = state[open_] * (model.root + 1) + token[open_]
            arc = np.minimum(np.searchsorted(model.keys, key), len(model.keys) - 1)
            hit = model.keys[arc] == key
            weight[open_[hit]] += model.weight[arc[hit]]
            after[open_[hit]] = model.leads_to[arc[hit]]
        open_ = open_[~hit]
        weight[open_] += model.failure_weight[state[open_]]
        state[open_] = model.failure[state[open_]]
    return after, weight


def traverse(model: Automaton, tokens: np.ndarray, offsets: np.ndarray, segment: int = SEGMENT) -> np.ndarray:
    """Sum of weights on the path of each text; text i is tokens[offsets[i]:offsets[i + 1]].

    Texts are read from left to right, all at once, each in a lane of its own that carries its state. A
    text of more than `segment` tokens has several lanes. As a state depends on the last order - 1 tokens
    alone, a later lane reads those from the root before its own, and their weights do not count."""
    sizes = np.diff(offsets)
    lanes = np.maximum(-(-sizes // segment), 1)
    text = np.repeat(np.arange(len(sizes)), lanes)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
    own = offsets[text] + nth * segment
    end = np.minimum(own + segment, offsets[text + 1])
    begin = np.maximum(own - (model.order - 1), offsets[text])
    state = np.where(begin == offsets[text], model.start, model.root)
    by_length = np.argsort(begin - end, kind="stable")
    text, own, begin, state, rest = (x[by_length] for x in (text, own, begin, state, begin - end))
    total = np.zeros(len(text))
    for i in range(int(-rest.min(initial=0))):
        active = int(np.searchsorted(rest, -i))                       # lanes with a token left
        place = begin[:active] + i
        state[:active], weight = _step(model, state[:active], tokens[place])
        total[:active] += np.where(place >= own[:active], weight, 0)
    return np.bincount(text, total, len(sizes))
