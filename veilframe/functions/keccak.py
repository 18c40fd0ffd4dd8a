"""Keccak-256 with the original padding (0x01), which differs from the standardised SHA3-256; for kernels."""

from __future__ import annotations

MASK = (1 << 64) - 1
RATE = 136


def round_constants() -> list[int]:
    """The 24 constants by their rule: bits of a linear feedback register at positions 2^j - 1."""
    out, lfsr = [], 1
    for _ in range(24):
        constant = 0
        for j in range(7):
            if lfsr & 1:
                constant |= 1 << ((1 << j) - 1)
            lfsr = (lfsr << 1) ^ (0x171 if lfsr & 0x80 else 0)
        out.append(constant)
    return out


def lane_walk() -> list[tuple[int, int]]:
    """(lane, rotation) in the order in which the rho and pi steps visit the lanes, by their rule."""
    out, x, y = [], 1, 0
    for t in range(24):
        x, y = y, (2 * x + 3 * y) % 5
        out.append((x + 5 * y, (t + 1) * (t + 2) // 2 % 64))
    return out


ROUNDS, WALK = round_constants(), lane_walk()


def turn(v: int, n: int) -> int:
    return (v << n | v >> (64 - n)) & MASK if n else v


def permute(a: list[int]) -> list[int]:
    for constant in ROUNDS:
        column = [a[x] ^ a[x + 5] ^ a[x + 10] ^ a[x + 15] ^ a[x + 20] for x in range(5)]
        mix = [column[(x + 4) % 5] ^ turn(column[(x + 1) % 5], 1) for x in range(5)]
        a = [v ^ mix[i % 5] for i, v in enumerate(a)]
        carried = a[1]
        for lane, n in WALK:
            a[lane], carried = turn(carried, n), a[lane]
        a = [a[i] ^ (~a[i - i % 5 + (i + 1) % 5] & MASK & a[i - i % 5 + (i + 2) % 5]) for i in range(25)]
        a[0] ^= constant
    return a


def keccak256(data: bytes) -> bytes:
    fill = RATE - len(data) % RATE
    padded = bytearray(data) + bytes(fill)
    padded[len(data)] ^= 1
    padded[-1] ^= 0x80
    state = [0] * 25
    for at in range(0, len(padded), RATE):
        for i in range(RATE // 8):
            state[i] ^= int.from_bytes(padded[at + 8 * i : at + 8 * i + 8], "little")
        state = permute(state)
    return b"".join(v.to_bytes(8, "little") for v in state[:4])
