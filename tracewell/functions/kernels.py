"""NumPy kernels of factors over distributions: transforms and the messages of each operation.

Arrays are (executions, classes). A message to one operand is the sum over all assignments of the
others that satisfy the factor, of the product of their beliefs.
"""

from __future__ import annotations

import numpy as np

from .scalar import MIN_PROBABILITY


def walsh_hadamard(p: np.ndarray) -> np.ndarray:
    """Unnormalised, its own inverse up to the number of classes."""
    out, h, n = p.astype(float).copy(), 1, p.shape[-1]
    while h < n:
        v = out.reshape(*out.shape[:-1], n // (2 * h), 2, h)
        a, b = v[..., 0, :] + v[..., 1, :], v[..., 0, :] - v[..., 1, :]
        out = np.stack([a, b], axis=-2).reshape(p.shape)
        h *= 2
    return out


def superset_sums(p: np.ndarray, inverse: bool = False) -> np.ndarray:
    """Entry i sums the entries whose index holds all bits of i (or undoes that)."""
    out, h, n = p.astype(float).copy(), 1, p.shape[-1]
    while h < n:
        v = out.reshape(*out.shape[:-1], n // (2 * h), 2, h)
        v[..., 0, :] += -v[..., 1, :] if inverse else v[..., 1, :]
        h *= 2
    return out


def and_result_transform(p: np.ndarray) -> np.ndarray:
    """Along each bit (a, b) becomes (a, a - b); its own inverse. Turns the pull of an AND's result into products."""
    out, h, n = p.astype(float).copy(), 1, p.shape[-1]
    while h < n:
        v = out.reshape(*out.shape[:-1], n // (2 * h), 2, h)
        v[..., 1, :] = v[..., 0, :] - v[..., 1, :]
        h *= 2
    return out


def negated_bits(p: np.ndarray) -> np.ndarray:
    """The distribution of the complement."""
    return p[..., ::-1]


def negated_sum(p: np.ndarray) -> np.ndarray:
    """The distribution of -x modulo the number of classes."""
    return np.roll(p[..., ::-1], 1, axis=-1)


def regularised(p: np.ndarray) -> np.ndarray:
    """Moved up to be non-negative, then shares of the sum. All zero: a contradiction, left at zero."""
    low = np.minimum(p.min(axis=-1, keepdims=True), 0.0)
    p = p - low
    total = p.sum(axis=-1, keepdims=True)
    return np.divide(p, total, out=np.zeros_like(p), where=total > 0)


def clipped(p: np.ndarray) -> np.ndarray:
    return np.where(np.abs(p) >= MIN_PROBABILITY, p, np.where(p < 0, -MIN_PROBABILITY, MIN_PROBABILITY))


def exclusive_products(parts: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """(product of all, for each the product of the others), without division and renormalised on the way."""
    n = len(parts)
    before, after = [None] * n, [None] * n
    run = None
    for i in range(n):
        before[i] = run
        run = parts[i] if run is None else scaled(run * parts[i])
    whole, run = run, None
    for i in reversed(range(n)):
        after[i] = run
        run = parts[i] if run is None else scaled(run * parts[i])
    others = []
    for b, a, p in zip(before, after, parts, strict=True):
        others.append(np.ones_like(p) if b is None and a is None else b if a is None else a if b is None else scaled(b * a))
    return whole, others


def scaled(p: np.ndarray) -> np.ndarray:
    top = np.abs(p).max(axis=-1, keepdims=True)
    return np.divide(p, top, out=np.zeros_like(p), where=top > 0)


def xor_message(others: list[np.ndarray], constant: np.ndarray) -> np.ndarray:
    """The message to any operand of an xor: the distribution of the others' xor, with the constant."""
    nc = others[0].shape[-1] if others else None
    product = walsh_hadamard(others[0])
    for p in others[1:]:
        product = product * walsh_hadamard(p)
    out = walsh_hadamard(product) / nc
    return np.take_along_axis(out, np.arange(nc)[None, :] ^ constant[:, None], axis=-1)


def sum_distribution(terms: list[np.ndarray], constant: np.ndarray) -> np.ndarray:
    """The distribution of the sum of independent terms and a constant, modulo the number of classes."""
    nc = terms[0].shape[-1]
    product = np.fft.rfft(terms[0])
    for p in terms[1:]:
        product = product * np.fft.rfft(p)
    out = np.fft.irfft(product, n=nc) if nc > 1 else np.ones_like(terms[0])
    return np.take_along_axis(out, (np.arange(nc)[None, :] - constant[:, None]) % nc, axis=-1)


def and_forward(operands: list[np.ndarray], constant: np.ndarray) -> np.ndarray:
    """The distribution of the AND of independent operands and a constant."""
    nc = operands[0].shape[-1]
    product = superset_sums(operands[0])
    for p in operands[1:]:
        product = product * superset_sums(p)
    product = product * ((np.arange(nc)[None, :] & ~constant[:, None]) == 0)
    return superset_sums(product, inverse=True)


def and_backward(result: np.ndarray, others: list[np.ndarray], constant: np.ndarray) -> np.ndarray:
    """The message to one operand x: sum over y of P(others' AND, with the constant, is y) result[x & y]."""
    rest = and_forward(others, constant) if others else np.eye(result.shape[-1])[constant]
    return and_result_transform(and_result_transform(result) * superset_sums(rest))


def multiply_forward(operands: list[np.ndarray], constant: np.ndarray) -> np.ndarray:
    """The distribution of the product of independent operands and a constant, modulo the number of classes."""
    n, nc = operands[0].shape
    out = np.zeros((n, nc))
    out[np.arange(n), constant % nc] = 1.0
    index = np.arange(nc)
    for p in operands:
        new = np.zeros_like(out)
        for a in range(nc):
            np.add.at(new, (slice(None), index * a % nc), out * p[:, a : a + 1])
        out = new
    return out


def multiply_backward(result: np.ndarray, others: list[np.ndarray], constant: np.ndarray) -> np.ndarray:
    n, nc = result.shape
    rest = multiply_forward(others, constant) if others else np.eye(nc)[constant % nc]
    index, out = np.arange(nc), np.zeros((n, nc))
    for y in range(nc):
        out += rest[:, y : y + 1] * result[:, index * y % nc]
    return out


def lookup_forward(p: np.ndarray, table: np.ndarray) -> np.ndarray:
    out = np.zeros_like(p)
    np.add.at(out, (slice(None), table), p)
    return out


def lookup_backward(p: np.ndarray, table: np.ndarray) -> np.ndarray:
    return p[:, table]
