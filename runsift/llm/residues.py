"""Exact integer matrix products in a residue number system.

Integer matrices are reduced modulo several small primes; the residues, taken around
zero, are multiplied as float32, where every partial sum of a panel stays below 2^24
and so is exact; Chinese remaindering puts the signed products together. How many
primes are needed follows from a bound on the products.
"""

from __future__ import annotations

import numpy as np

#: Largest primes below 256: residues around zero have 7 bits.
PRIMES = [p for p in range(255, 2, -1) if all(p % q for q in range(2, 16))]
#: So many products of two residues can be summed below 2^24.
PANEL = (1 << 24) // (128 * 128)
LONG = (1 << 63) - 1


def base(bound: int) -> list[int]:
    """Primes whose product tells all integers of up to +-bound apart."""
    chosen, product = [], 1
    for p in PRIMES:
        if product > 2 * bound + 1:
            break
        chosen.append(p)
        product *= p
    if product <= 2 * bound + 1:
        raise ValueError(f"products of up to {bound} need more primes")
    return chosen


def residues(rows: np.ndarray, primes: list[int]) -> list[np.ndarray]:
    """For each prime the float32 residues around zero of a matrix of whole doubles."""
    out = []
    for p in primes:
        r = np.fmod(rows, p)  # exact for every double
        out.append((r - p * np.rint(r / p)).astype(np.float32))
    return out


def products(left: list[np.ndarray], right: list[np.ndarray], primes: list[int]) -> np.ndarray:
    """left @ right.T from their residues: int64, or Python integers cut to a long's range where that may be too small."""
    modulus = 1
    for p in primes:
        modulus *= p
    small = modulus.bit_length() + len(primes).bit_length() < 63
    total = np.zeros((len(left[0]), len(right[0])), np.int64 if small else object)
    for p, a, b in zip(primes, left, right):
        of_p = np.zeros(total.shape, np.float32)
        for at in range(0, a.shape[1], PANEL):
            panel = a[:, at : at + PANEL] @ b[:, at : at + PANEL].T
            of_p += panel - np.float32(p) * np.rint(panel / np.float32(p))
            of_p -= np.float32(p) * np.rint(of_p / np.float32(p))
        rest = modulus // p
        digit = np.mod(of_p.astype(np.int64) * pow(rest, -1, p), p)
        total += digit * rest if small else digit.astype(object) * rest
    total %= modulus
    if small:
        return np.where(total > modulus // 2, total - modulus, total)
    signed = np.where(total > modulus // 2, total - modulus, total)
    return np.clip(signed, -LONG - 1, LONG).astype(np.int64)
