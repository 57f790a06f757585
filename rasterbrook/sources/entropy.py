"""Entropy-coded JPEG segments cut into chunks whose decoders run side by side, with or without restart markers.

A decoder that starts anywhere falls into step with the right one after some
blocks: from a block start that both reach (same bit, same block of the MCU)
they read alike. So each chunk is first read from its own first bit, as if a
block of the MCU's first kind began there, up to the first block start behind
its end. Then each takes the place at which its neighbour left off, and reads
from there until it reaches a block start that it has passed before; what
follows is known. This is repeated for the chunks whose place has changed. When
none has, all are right, since the first chunk of a segment is: nothing is
assumed about how soon decoders fall into step, which only saves time.

All lanes (a lane is a chunk's decoder) go in step, a symbol of each at a time.
Where the tables of an MCU's blocks repeat with a shorter period, block kinds
count modulo that period, since bits alone can't tell them apart.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

#: Bytes of a chunk, and of the longest block: 64 codes of 16 bits with 11 bits of value.
CHUNK = 256
LONGEST_BLOCK = 64 * 27 // 8
_ZRL = 0xF0
_CUT, _CODE, _SIZE, _RUN = 1, 2, 3, 4
REASONS = {_CUT: "a segment is cut short", _CODE: "an undefined code", _SIZE: "a coefficient is too large", _RUN: "a run beyond the block"}


def _period(kinds: list[tuple]) -> int:
    return next(p for p in range(1, len(kinds) + 1) if len(kinds) % p == 0 and kinds == kinds[:p] * (len(kinds) // p))


#: Look-ups as codes: bits taken, size of the value, places gone on (64 ends a block), and whether it is an error.
_TAKEN, _SIZE_AT, _STEP_AT, _BAD_AT = 31, 5, 9, 16
_codes: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
_HALF = np.array([0, *(1 << n for n in range(15))], np.int64)
_LOW = np.array([1 - (1 << n) for n in range(16)], np.int64)


def _coded(table: np.ndarray, is_ac: int) -> np.ndarray:
    """A look-up (length and symbol of each 16-bit word) as codes; those made of late are kept."""
    found = _codes.get((id(table), is_ac))
    if found is None:
        entry = table.astype(np.int32)
        size, symbol = entry >> 8, entry & 255
        s, ends = symbol & 15, (symbol == 0) & (is_ac == 1)
        step = np.where(ends, 64, (symbol >> 4) * is_ac + 1)
        bad = (size == 0) | (s + is_ac > 11) | (is_ac == 1) & (s == 0) & ~ends & (symbol != _ZRL)
        if len(_codes) >= 256:
            _codes.clear()
        found = _codes[id(table), is_ac] = table, (size + s) | s << _SIZE_AT | step << _STEP_AT | bad.astype(np.int32) << _BAD_AT
    return found[1]


class Streams:
    """Segments in one buffer, with what their decoding needs. pattern: the component of each block of an MCU; dc, ac: 16-bit look-ups by component."""

    def __init__(self, parts: list[bytes], patterns: list[tuple[int, ...]], dc: list[list[np.ndarray]], ac: list[list[np.ndarray]]):
        sizes = np.array([len(p) for p in parts], np.int64)
        self.first = np.concatenate(([0], np.cumsum(sizes + 8)[:-1])) * 8
        self.limit = self.first + sizes * 8
        raw = np.frombuffer(b"".join(p + b"\0" * 8 for p in parts), np.uint8).astype(np.int64)
        window = raw[: len(raw) - 4].copy()
        for j in range(1, 5):
            window = window << 8 | raw[j : j + len(window)]
        self.window = np.append(window, [0] * 4)
        place: dict[tuple[int, int], int] = {}
        stacks: list[np.ndarray] = []
        for is_ac, rows in enumerate((dc, ac)):
            for row in {id(r): r for r in rows}.values():
                for t in row:
                    if (id(t), is_ac) not in place:
                        place[id(t), is_ac] = len(stacks)
                        stacks.append(_coded(t, is_ac))
        self.tables = np.concatenate(stacks)
        most = max(map(len, patterns))
        seen: dict[tuple, int] = {}
        kinds: list[tuple] = []
        of = []
        for p, d, a in zip(patterns, dc, ac, strict=True):
            key = (p, id(d), id(a))
            if key not in seen:
                seen[key] = len(kinds)
                kinds.append((p, [place[id(x), 0] for x in d], [place[id(x), 1] for x in a]))
            of.append(seen[key])
        self.kind = np.array(of, np.int64)
        self.length = np.array([len(p) for p, _, _ in kinds], np.int64)
        self.pattern = np.array([[*p, *[0] * (most - len(p))] for p, _, _ in kinds], np.int64)
        # the look-up of each kind, DC or AC, and block of the MCU
        self.lookup = np.array([[[t[c] << 16 for c in p] + [0] * (most - len(p)) for t in (d, a)] for p, d, a in kinds], np.int64).ravel()
        self.width = most
        self.period = np.array([_period([(d[c], a[c]) for c in p]) for p, d, a in kinds], np.int64)

    def symbols(self, kind: np.ndarray, bit: np.ndarray, limit: np.ndarray, block: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, ...]:
        """One symbol of each lane: (bits taken, the next place, size of the value, the value, why it fails or 0, or None if none fails)."""
        view, offset = self.window.take(bit >> 3, mode="clip"), bit & 7
        at = self.lookup.take((2 * kind + (k > 0)) * self.width + block)
        code = self.tables.take(at + (view >> (24 - offset) & 0xFFFF)).astype(np.int64)
        taken, s, step = code & _TAKEN, code >> _SIZE_AT & 15, code >> _STEP_AT & 127
        value = view >> np.maximum(40 - offset - taken, 0) & _HALF.take(s) * 2 - (s > 0)
        value = np.where(value < _HALF.take(s), value + _LOW.take(s), value)
        after = k + step
        bad, over, cut = code >> _BAD_AT != 0, (after > 64) & (step < 64), bit + taken > limit
        if not (bad | over | cut).any():
            return taken, after, s, value, None
        reason = np.where(over, _RUN, 0)
        reason = np.where(bad, np.where(step > 16, _CODE, np.where(taken == 0, _CODE, np.where(s > 9, _SIZE, _RUN))), reason)
        return taken, after, s, value, np.where(cut, _CUT, reason)


@dataclass
class Lanes:
    """Decoders: each reads a segment from a bit, at a block of its MCU (modulo the period), until a block starts at or behind end."""

    segment: np.ndarray
    bit: np.ndarray
    block: np.ndarray
    end: np.ndarray
    # where each left off, its blocks, and their DC differences' sums by place in the MCU, counted from its first block
    exit: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    exit_block: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    blocks: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    sums: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.int64))
    # whether it could not go on somewhere, and whether it ran on its own to its exit
    lost: np.ndarray = field(default_factory=lambda: np.zeros(0, bool))
    alone: np.ndarray = field(default_factory=lambda: np.zeros(0, bool))


@dataclass
class Passed:
    """Block starts that a lane has passed: code tells lane, bit and block; what remains from there to the lane's exit."""

    code: np.ndarray
    blocks: np.ndarray
    sums: np.ndarray

    @staticmethod
    def codes(lane: np.ndarray, bit: np.ndarray, block: np.ndarray) -> np.ndarray:
        return (lane << 38 | bit) << 5 | block

    def sorted(self) -> Passed:
        order = np.argsort(self.code, kind="stable")
        return Passed(self.code[order], self.blocks[order], self.sums[order])

    def without(self, lanes: np.ndarray) -> Passed:
        """Without the starts of marked lanes: they lead to exits that no longer hold."""
        keep = ~lanes[self.code >> 43]
        return Passed(self.code[keep], self.blocks[keep], self.sums[keep])

    def with_(self, other: Passed) -> Passed:
        return Passed(np.concatenate((self.code, other.code)), np.concatenate((self.blocks, other.blocks)), np.concatenate((self.sums, other.sums))).sorted()


def _turned(sums: np.ndarray, by: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Sums by place counted from a first block, counted from by blocks later."""
    place = (np.arange(sums.shape[1])[None, :] + by[:, None]) % length[:, None]
    return np.where(np.arange(sums.shape[1])[None, :] < length[:, None], np.take_along_axis(sums, place, 1), 0)


def measure(streams: Streams, lanes: Lanes, which: np.ndarray, passed: Passed | None) -> Passed:
    """Runs some lanes from their bit and block to their exit, or to a block start passed before; fills in their exits and returns the starts that are new.

    A decoder that can't go on starts again a bit later: it wasn't in step.
    """
    segment, lane = lanes.segment[which], which
    kind, limit, end = streams.kind[segment], streams.limit[segment], lanes.end[which]
    period, length, width = streams.period[kind], streams.length[kind], streams.pattern.shape[1]
    bit, block, k = lanes.bit[which].copy(), lanes.block[which].copy(), np.zeros(len(which), np.int64)
    blocks, sums, epoch = np.zeros(len(which), np.int64), np.zeros((len(which), width), np.int64), np.zeros(len(which), np.int64)
    done, joined = np.zeros(len(which), bool), np.zeros(len(which), bool)
    new: list[tuple] = []
    while True:
        starts = np.flatnonzero(~done & (k == 0))
        over = starts[bit[starts] >= end[starts]]
        done[over] = True
        lanes.exit[lane[over]], lanes.exit_block[lane[over]] = bit[over], block[over]
        starts = starts[bit[starts] < end[starts]]
        if passed is not None and len(passed.code) and len(starts):
            code = Passed.codes(lane[starts], bit[starts], block[starts])
            at = np.minimum(np.searchsorted(passed.code, code), len(passed.code) - 1)
            hit = passed.code[at] == code
            known, at = starts[hit], at[hit]
            # the rest is known: its sums are by place from here
            sums[known] += _turned(passed.sums[at], -blocks[known], length[known])
            blocks[known] += passed.blocks[at]
            done[known] = joined[known] = True
            starts = starts[~hit]
        if len(starts):
            new.append((starts, bit[starts], block[starts], blocks[starts], sums[starts], epoch[starts]))
        live = np.flatnonzero(~done)
        if not len(live):
            break
        taken, after, _, value, reason = streams.symbols(kind[live], bit[live], limit[live], block[live], k[live])
        bad = np.zeros(len(live), bool) if reason is None else reason > 0
        fine, at = live[~bad], k[live[~bad]]
        dc = fine[at == 0]
        sums[dc, blocks[dc] % length[dc]] += value[~bad][at == 0]
        bit[fine] += taken[~bad]
        k[fine] = after[~bad]
        ended = fine[k[fine] > 63]
        k[ended] = 0
        blocks[ended] += 1
        block[ended] = (block[ended] + 1) % period[ended]
        lost = live[bad]
        bit[lost] += 1
        k[lost] = block[lost] = blocks[lost] = sums[lost] = 0
        epoch[lost] += 1
        gone = lost[bit[lost] >= limit[lost]]  # no exit: what comes next has no right place to start at
        done[gone] = True
        lanes.exit[lane[gone]], lanes.exit_block[lane[gone]] = limit[gone], 0
    lanes.blocks[which], lanes.sums[which], lanes.lost[which] = blocks, sums, epoch > 0
    lanes.alone[which] = ~joined
    if not new:
        return Passed(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, width), np.int64))
    own, bits, kinds, before, partial, when = (np.concatenate(x) for x in zip(*new, strict=True))
    last = when == epoch[own]  # starts before a decoder lost its step lead nowhere
    own, bits, kinds, before, partial = own[last], bits[last], kinds[last], before[last], partial[last]
    return Passed(Passed.codes(lane[own], bits, kinds), blocks[own] - before, _turned(sums[own] - partial, before, length[own]))


def prepared(streams: Streams, segment: np.ndarray, bit: np.ndarray, end: np.ndarray) -> Lanes:
    """Lanes that have not run; each starts as if a block of the first kind began at its bit."""
    n, width = len(segment), streams.pattern.shape[1]
    zero = lambda: np.zeros(n, np.int64)
    return Lanes(segment, bit.copy(), zero(), end, zero(), zero(), zero(), np.zeros((n, width), np.int64), np.zeros(n, bool), np.zeros(n, bool))


def synchronised(streams: Streams, segment: np.ndarray, bit: np.ndarray, end: np.ndarray) -> Lanes:
    """Lanes in order of their place in their segments, each with its right start. The first of a segment starts at its first bit."""
    lanes = prepared(streams, segment, bit, end)
    passed = measure(streams, lanes, np.arange(len(segment)), None).sorted()
    follows = np.flatnonzero(segment[1:] == segment[:-1]) + 1
    while True:
        moved = follows[(lanes.exit[follows - 1] != lanes.bit[follows]) | (lanes.exit_block[follows - 1] != lanes.block[follows])]
        if not len(moved):
            return lanes
        lanes.bit[moved], lanes.block[moved] = lanes.exit[moved - 1], lanes.exit_block[moved - 1]
        new, stale = measure(streams, lanes, moved, passed), np.zeros(len(segment), bool)
        stale[moved] = lanes.alone[moved]
        passed = passed.without(stale).with_(new)


def read_blocks(streams: Streams, segment: np.ndarray, bit: np.ndarray, first: np.ndarray, count: np.ndarray, row: np.ndarray, out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Reads count blocks of each lane, from a bit and a block number of its segment, into rows of out (zigzag, DC as differences); (the bit behind each, why it failed or 0)."""
    kind, limit = streams.kind[segment], streams.limit[segment]
    length = streams.length[kind]
    bit, k, left, failed = bit.copy(), np.zeros(len(segment), np.int64), count.copy(), np.zeros(len(segment), np.int64)
    block, row = first % length, row.copy()
    flat = out.reshape(-1)
    live = np.flatnonzero(left > 0)
    while len(live):
        taken, after, s, value, reason = streams.symbols(kind[live], bit[live], limit[live], block[live], k[live])
        if reason is not None:
            bad = reason > 0
            failed[live[bad]] = reason[bad]
            live, taken, after, s, value = live[~bad], taken[~bad], after[~bad], s[~bad], value[~bad]
        real = np.flatnonzero(s)
        flat[row[live[real]] * 64 + after[real] - 1] = value[real]
        bit[live] += taken
        k[live] = after
        ended = live[after > 63]
        if len(ended):
            k[ended] = 0
            row[ended] += 1
            left[ended] -= 1
            block[ended] = (block[ended] + 1) % length[ended]
            live = live[left[live] > 0]
    return bit, failed


def decode(streams: Streams, n_mcus: np.ndarray, chunk: int = CHUNK) -> list[np.ndarray | ValueError]:
    """(mcus, blocks of an MCU, 64) zigzag coefficients of each segment, or what is wrong with it."""
    total = n_mcus * streams.length[streams.kind]
    size = (streams.limit - streams.first) // 8
    short = total * 2 > size * 8  # a block takes two bits at least
    whole = np.where(short, 0, total)
    lanes_of = np.where(short | (size < 3 * chunk), 1, -(-size // chunk))
    segment = np.repeat(np.arange(len(total)), lanes_of)
    turn = np.arange(len(segment)) - np.repeat(np.cumsum(lanes_of) - lanes_of, lanes_of)
    bit = streams.first[segment] + turn * chunk * 8
    first, count = np.zeros(len(segment), np.int64), whole[segment]
    cut = np.flatnonzero(lanes_of[segment] > 1)
    if len(cut):
        is_last = turn[cut] == lanes_of[segment[cut]] - 1
        end = np.where(is_last, streams.limit[segment[cut]], bit[cut] + chunk * 8)
        lanes = synchronised(streams, segment[cut], bit[cut], end)
        bit[cut] = lanes.bit
        running = np.cumsum(lanes.blocks) - lanes.blocks
        opening = np.flatnonzero(turn[cut] == 0)
        running -= np.repeat(running[opening], lanes_of[segment[cut[opening]]])
        most = whole[segment[cut]]
        first[cut] = np.minimum(running, most)
        count[cut] = np.where(is_last, most - first[cut], np.minimum(running + lanes.blocks, most) - first[cut])
    base = np.concatenate(([0], np.cumsum(whole)))
    out = np.zeros((int(base[-1]), 64), np.int16)
    behind, failed = read_blocks(streams, segment, bit, first, count, base[segment] + first, out)
    everything = np.arange(len(total))
    dc = dc_values(out[:, 0].astype(np.int64), whole, components(streams, everything, np.zeros_like(whole), whole))
    found: list[np.ndarray | ValueError] = []
    ends = np.cumsum(lanes_of)
    for i, (a, b) in enumerate(zip(ends - lanes_of, ends, strict=True)):
        why = REASONS[_CUT] if short[i] else REASONS.get(int(failed[a:b].max()), "")
        # the lane that read the last block tells where it ended
        worked = a + np.flatnonzero(count[a:b])
        own = dc[base[i] : base[i + 1]]
        if not why and streams.limit[i] - (behind[worked[-1]] if len(worked) else streams.first[i]) >= 8:
            why = "bytes are left in a segment"
        if not why and len(own) and max(own.max(), -own.min()) > 32767:
            why = REASONS[_SIZE]
        if why:
            found.append(ValueError(why))
            continue
        rows = out[base[i] : base[i + 1]]
        rows[:, 0] = own
        found.append(rows.reshape(int(n_mcus[i]), -1, 64))
    return found


def components(streams: Streams, segment: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The component of each block of lanes that hold size blocks from the first-th of their segments."""
    owner = np.repeat(np.arange(len(size)), size)
    turn = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
    kind = streams.kind[segment[owner]]
    return streams.pattern[kind, (first[owner] + turn) % streams.length[kind]]


def dc_values(difference: np.ndarray, size: np.ndarray, component: np.ndarray) -> np.ndarray:
    """Running sums of DC differences by lane and component; size: each lane's blocks."""
    out = np.zeros(len(difference), np.int64)
    owner = np.repeat(np.arange(len(size)), size)
    start = np.cumsum(size) - size
    for c in range(3):
        own = np.flatnonzero(component == c)
        sums = np.cumsum(difference[own])
        before = np.concatenate(([0], sums))[np.searchsorted(own, start)]
        out[own] = sums - before[owner[own]]
    return out
