"""Pseudo-random sequences for test graphs."""

from __future__ import annotations

from collections.abc import Iterator


def shift_register(state: int, taps: int = 0xD0000001) -> Iterator[int]:
    """A 32-bit linear feedback shift register in Galois form."""
    while True:
        state = (state >> 1) ^ (taps if state & 1 else 0)
        yield state


def xorshift(words: tuple[int, int, int, int] = (123456789, 362436069, 521288629, 88675123)) -> Iterator[int]:
    """Marsaglia's xorshift generator of four 32-bit words, of period 2**128 - 1; the default words are those of his paper."""
    state, mask = list(words), 0xFFFFFFFF
    while True:
        first, last = state.pop(0), state[-1]
        first ^= first << 11 & mask
        state.append(last ^ last >> 19 ^ first ^ first >> 8)
        yield state[-1]
