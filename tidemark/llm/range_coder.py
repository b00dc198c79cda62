"""Adaptive context-mixing range coder for token ids below 65,536.

Ids are cut into blocks that are coded side by side: every array below has one entry a block, and one step codes the
next id of all blocks. A block starts from the same empty model, so it can be decoded without the others.

The model of a block predicts the next id from the last two (order 2) and from the last one (order 1): hashed tables hold
the id that followed there last and how often that was right. Which prediction holds is a three-way choice; its
distribution mixes (adds) adaptive counts seen under the confidence of order 2 and under that of order 1. What a run of
steps has shown is entered into the tables at its end, and into the distributions at the end of a longer span, so that
either is done for many ids at once.
An id that neither predicts is coded by order 0: fixed shares of 2**16 that the caller gives for all blocks, as counted by
``shares``; without them all ids are alike. All of it is integer arithmetic
but for quotients in doubles, the same in both directions.

The coder is a range coder that carries: 48-bit low end, 16-bit words out, a range of at least 2**32 before each id. As the
encoder knows the ids of a run, it looks up all their ranges first and then only narrows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_SLOTS = 1 << 8
_WORD = 16
_MASK, _BOTTOM = (1 << 48) - 1, 1 << 32
_SHARES = 1 << 16
_HALF = 20  # bits of the lower of two numbers in one integer
_LOWER = (1 << _HALF) - 1
_RUN = 16  # steps between two changes of the tables of guesses
_SPANS = (16, 64, 256)  # steps before which the distributions change first
_SPAN = 512  # steps between their later changes, and between halvings of the counts
_ID, _SURE = 65535, 1 << 16  # a guess: the id that followed, and above it the confidence (0 to 3)


def shares(ids: np.ndarray) -> np.ndarray:
    """Shares of 2**16 for the ids by their counts, at least one for each that occurs."""
    counts = np.bincount(ids, minlength=_SHARES).astype(np.int64)
    if not len(ids):
        return np.ones(_SHARES, np.int64)
    out = np.maximum(counts * (_SHARES - np.count_nonzero(counts)) // len(ids), counts > 0)
    out[counts.argmax()] += _SHARES - out.sum()
    return out


def _at(values: np.ndarray, places: np.ndarray) -> np.ndarray:
    return values.take(places, mode="clip")


def _quotient(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a // b, exact for a below 2**53, as a quotient is rounded by less than its distance to the next integer."""
    return (a.astype(np.float64) / b.astype(np.float64)).astype(np.int64)


def _runs(live: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """First step of each run, its end, and how many blocks are going at its start."""
    for begin in range(0, len(live), _RUN):
        yield begin, min(begin + _RUN, len(live)), int(live[begin])


class _Model:
    """State of all blocks, longer blocks first."""

    def __init__(self, blocks: int, order_0: np.ndarray | None):
        share = np.ones(_SHARES, np.int64) if order_0 is None else order_0.astype(np.int64)
        if len(share) != _SHARES or share.min() < 0 or share.sum() != _SHARES:
            raise ValueError("shares of ids that do not add up")
        # order 0 by id: share, and above it the shares before
        self.order_0 = share | np.cumsum(share) - share << _HALF
        # the id of each share
        self.owner = np.repeat(np.arange(_SHARES, dtype=np.uint16), share)
        lane = np.arange(blocks)
        # guesses by the last id, then by the last two
        self.guess = np.zeros(2 * blocks * _SLOTS, np.int32)
        self.slots = np.array([lane, lane + blocks]) * _SLOTS
        # counts of the three choices (order 2 is right, order 1, neither) by confidence of order 2, and by confidence of
        # order 1 and agreement of both
        self.by_2, self.by_1 = np.full((blocks, 4, 1, 3), 4, np.int64), np.full((blocks, 1, 8, 3), 4, np.int64)
        self.rows = lane * 32
        self.chosen: list[np.ndarray] = []
        self._mix()

    def spots(self, last: np.ndarray, before: np.ndarray, out: np.ndarray) -> None:
        """Where the guesses for the next ids stand: by ``last``, and by it and the id ``before``."""
        mark = last * 40503
        np.right_shift(mark, 4, out=out[..., 0, :])
        mark += before * 60493
        np.right_shift(mark, 5, out=out[..., 1, :])
        out &= _SLOTS - 1
        out += self.slots[:, : out.shape[-1]]

    def row(self, sure_1: np.ndarray, sure_2: np.ndarray, same: np.ndarray) -> np.ndarray:
        """Which distribution holds under these confidences and this agreement of the guesses."""
        row = sure_2 << 2
        row |= sure_1
        row <<= 1
        row |= same
        row += self.rows[: row.shape[-1]]
        return row

    def follow(self, begin: int, end: int, spots: np.ndarray, held: np.ndarray, ids: np.ndarray, chosen: np.ndarray) -> None:
        """Enter a run: the ids that followed where these guesses were held, and the choices (4 * row + choice).

        Right guesses gain confidence, wrong ones lose two of it or their place. Of several at one spot the last counts.
        """
        ids = ids[:, None]
        kept = np.where(held < 2 * _SURE, ids, held - 2 * _SURE)
        self.guess[spots] = np.where((held & _ID) == ids, np.minimum(held + _SURE, held | 3 * _SURE), kept)
        self.chosen.append(chosen)
        if end in _SPANS or end % _SPAN == 0:
            live = chosen.shape[-1]
            seen = np.concatenate([c[:, :live].ravel() for c in self.chosen])
            seen = np.bincount(seen, minlength=live * 128).reshape(live, 4, 8, 4)[..., :3]
            for counts, axis in ((self.by_2[:live], 2), (self.by_1[:live], 1)):
                counts += 16 * seen.sum(axis=axis, keepdims=True)
                if end % _SPAN == 0:
                    counts -= counts >> 1
            self.chosen = []
            self._mix()

    def _mix(self) -> None:
        """Ends of the ranges of order 2 and of order 1 in 2**16, by row."""
        mix = self.by_2 + self.by_1
        first, one = mix[..., 0], mix[..., 1]
        one[..., 1::2] = 0  # order 1 that agrees is never the choice
        one += first
        scale = float(_SHARES) / (one + mix[..., 2])
        self.first, self.either = ((n * scale).astype(np.int64).ravel() for n in (first, one))


def _moves(span: np.ndarray) -> np.ndarray:
    """How many words leave the low ends of these ranges: one of most, two of few."""
    return (span < _BOTTOM).view(np.int8) + (span < _BOTTOM >> _WORD).view(np.int8)


class _Encoder:
    def __init__(self, blocks: int, longest: int):
        self.low = np.zeros(blocks, np.int64)
        self.range = np.full(blocks, _MASK)
        self.room = longest * 2 + 8
        self.words = np.zeros(blocks * self.room, np.int32)
        self.next = np.arange(blocks) * self.room

    def put(self, start: np.ndarray, size: np.ndarray, below: np.ndarray, share: np.ndarray, settled: np.ndarray, moves: np.ndarray) -> None:
        """Narrow each block's range to ``size`` from ``start`` on, and that to ``share`` from ``below`` on, all in 2**16.

        ``settled`` gets the upper two words of the low end and its carry above, ``moves`` how many of them leave it.
        """
        n = len(start)
        low, span = self.low[:n], self.range[:n]
        unit = span >> _WORD
        start *= unit
        unit *= size
        unit >>= _WORD
        low += start
        below *= unit
        low += below
        np.multiply(unit, share, out=span)
        moves[:] = _moves(span)
        np.right_shift(low, _WORD, out=settled)
        moved = moves << 4
        low <<= moved
        low &= _MASK
        span <<= moved

    def write(self, settled: np.ndarray, moves: np.ndarray) -> None:
        """Write what a run has settled; ones carried go to the word before."""
        n = settled.shape[-1]
        places = np.cumsum(moves, axis=0)
        places += self.next[:n]
        self.next[:n] = places[-1]
        places -= moves
        carry = places[settled > 0xFFFFFFFF]
        self.words[places] = settled >> _WORD & 65535  # without a move the next word stands there in the end
        second = np.nonzero(moves > 1)
        self.words[places[second] + 1] = settled[second] & 65535
        while len(carry):  # words of ones become zeros
            carry = carry - 1
            self.words[carry] += 1
            carry = carry[self.words[carry] > 65535]
            self.words[carry] = 0

    def finish(self) -> list[bytes]:
        for shift in (32, 16, 0):
            self.words[self.next] = self.low >> shift & 65535
            self.next += 1
        return [self.words[i * self.room : end].astype("<u2").tobytes() for i, end in enumerate(self.next)]


class _Decoder:
    def __init__(self, payloads: list[bytes]):
        sizes = np.array([len(p) // 2 for p in payloads], np.int64)
        words = np.concatenate([np.frombuffer(b"".join(p[: len(p) // 2 * 2] for p in payloads), "<u2"), np.zeros(9, "<u2")])
        self.pairs = words[:-1].astype(np.uint32) << 16 | words[1:]  # each word and the next one
        self.ends = np.cumsum(sizes)
        self.next = self.ends - sizes
        self.range = np.full(len(payloads), _MASK)
        self.value = _at(self.pairs, self.next).astype(np.int64) << _WORD | _at(self.pairs, self.next + 2) >> _WORD  # above the low end
        self.next += 3

    def get(self, first, either, one, two, model: _Model) -> tuple[np.ndarray, np.ndarray]:
        """The next ids and how they were chosen, given the ends of the ranges of order 2 and of order 1."""
        n = len(first)
        value, span, at = self.value[:n], self.range[:n], self.next[:n]
        unit = span >> _WORD
        first *= unit
        either *= unit
        beyond, rest = value >= first, value >= either
        unit <<= _WORD
        size = np.where(rest, unit, np.where(beyond, either, first))
        first *= beyond
        start = np.where(rest, either, first)
        value -= start
        size -= start
        size >>= _WORD
        # the id, and above it its shares of the range
        found = np.where(rest, _at(model.owner, _quotient(value, size)), np.where(beyond, one, two))
        order_0 = np.where(rest, _at(model.order_0, found), _SHARES)
        np.multiply(size, order_0 & _LOWER, out=span)
        order_0 >>= _HALF
        size *= order_0
        value -= size
        moves = _moves(span).astype(np.int64)
        words = _at(self.pairs, at).astype(np.int64)
        at += moves
        moves <<= 4
        value <<= moves
        span <<= moves
        words >>= 32 - moves
        value |= words
        return found, (beyond.view(np.int8) + rest.view(np.int8)).astype(np.int64)

    def finish(self) -> None:
        if self.value.any() or (self.next != self.ends).any():
            raise ValueError("block of token ids that does not end where it should")


def _by_length(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the blocks from long to short, and how many are still going at each step."""
    order = np.argsort(-lengths, kind="stable")
    longest = int(lengths.max()) if len(lengths) else 0
    return order, np.searchsorted(-lengths[order], -np.arange(longest), side="left")


def encode(blocks: list[np.ndarray], order_0: np.ndarray | None = None) -> list[bytes]:
    """Each block's ids as bytes."""
    lengths = np.array([len(b) for b in blocks], np.int64)
    order, live = _by_length(lengths)
    model, coder = _Model(len(blocks), order_0), _Encoder(len(blocks), int(lengths.max(initial=0)))
    ids = np.zeros((len(blocks), 2 + len(live)), np.uint16)  # two zeros stand before the first id
    for i, at in enumerate(order):
        ids[i, 2 : 2 + lengths[at]] = blocks[at]
    ids = np.ascontiguousarray(ids.T)
    for begin, end, n in _runs(live):  # what stands behind a block's end is not put
        wide = ids[begin : end + 2, :n].astype(np.int64)
        spots, coded = np.empty((end - begin, 2, n), np.int64), ids[begin + 2 : end + 2, :n].astype(np.int32)
        model.spots(wide[1:-1], wide[:-2], spots)
        held = _at(model.guess, spots)
        one, two = (held & _ID).transpose(1, 0, 2)
        choice = (coded != two).astype(np.int8)
        choice += choice & (coded != one)
        rows = model.row(*(held >> 16).astype(np.int64).transpose(1, 0, 2), one == two)
        first, either, rest = _at(model.first, rows), _at(model.either, rows), choice == 2
        start = np.where(rest, either, first * choice)
        size = np.where(rest, _SHARES, np.where(choice, either, first)) - start
        order_0 = np.where(rest, _at(model.order_0, wide[2:]), _SHARES)
        below, share = order_0 >> _HALF, order_0 & _LOWER
        run = start, size, below, share, *np.zeros((2, end - begin, n), np.int64)
        for step, going in enumerate(live[begin:end].tolist()):
            coder.put(*(part[step, :going] for part in run))
        coder.write(*run[4:])
        rows *= 4
        rows += choice
        model.follow(begin, end, spots, held, coded, rows)
    out = coder.finish()
    back = np.empty(len(blocks), np.int64)
    back[order] = np.arange(len(blocks))
    return [out[i] for i in back]


def decode(payloads: list[bytes], lengths: list[int], order_0: np.ndarray | None = None) -> list[np.ndarray]:
    """The ids of each block, from its bytes and their number; raises ValueError if they do not fit together."""
    sizes = np.array(lengths, np.int64)
    order, live = _by_length(sizes)
    model, coder = _Model(len(payloads), order_0), _Decoder([payloads[i] for i in order])
    ids = np.zeros((len(payloads), len(live)), np.uint16)
    last = before = np.zeros(len(payloads), np.int64)
    for begin, end, n in _runs(live):
        spots = np.empty((end - begin, 2, n), np.int64)
        held, found, chosen = np.zeros(spots.shape, np.int32), np.zeros((end - begin, n), np.int32), np.full((end - begin, n), 3)
        for step, going in enumerate(live[begin:end].tolist()):
            last, before, spot = last[:going], before[:going], spots[step]
            if going < n:
                spot[:, going:] = model.slots[:, going:n]
                spot = spot[:, :going]
            model.spots(last, before, spot)
            guess = _at(model.guess, spot)
            held[step, :, :going] = guess
            guess = guess.astype(np.int64)
            sure = guess >> 16
            guess &= _ID
            one, two = guess
            rows = model.row(*sure, one == two)
            before, (last, choice) = last, coder.get(_at(model.first, rows), _at(model.either, rows), one, two, model)
            rows <<= 2
            np.bitwise_or(rows, choice, out=chosen[step, :going])
            found[step, :going] = last
        ids[:n, begin:end] = found.T
        model.follow(begin, end, spots, held, found, chosen)
    coder.finish()
    out: list[np.ndarray] = [np.empty(0, np.uint16)] * len(payloads)
    for i, at in enumerate(order):
        out[at] = ids[i, : sizes[at]]
    return out
