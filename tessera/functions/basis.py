"""Dyadic second-kind Chebyshev basis: small matrices on the driver, which become literals or COO rows.

Level J has 2**J cells on [0, 1); a cell holds `modes` functions alpha * U_m(u), u its local coordinate in [-1, 1].
Flat index: cell * modes + mode.
"""

from __future__ import annotations

import math

import numpy as np

EPS = float(np.finfo(float).eps)


def chebyshev_u(degree: int, x: np.ndarray | float) -> np.ndarray:
    """U_degree(x) by the three-term recurrence."""
    x = np.asarray(x, float)
    before, now = np.zeros_like(x), np.ones_like(x)
    for _ in range(degree):
        before, now = now, 2 * x * now - before
    return now


def u_table(modes: int, x: np.ndarray) -> np.ndarray:
    """modes x len(x)."""
    return np.array([chebyshev_u(m, x) for m in range(modes)])


def cell_bounds(level_j: int, cell: int) -> tuple[float, float]:
    n = 1 << level_j
    if not 0 <= cell < n:
        raise ValueError("cell out of range")
    return cell / n, (cell + 1) / n


def locate(level_j: int, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cell, local coordinate); t = 1 belongs to the last cell."""
    t = np.asarray(t, float)
    cell = np.minimum(np.floor(t * 2**level_j), 2**level_j - 1).astype(int)
    return cell, 2 ** (level_j + 1) * t - 2 * cell - 1


def scale(level_j: int) -> float:
    return math.sqrt(2 ** (level_j + 2) / math.pi)


def evaluate(level_j: int, cell: int, degree: int, t: np.ndarray) -> np.ndarray:
    """One basis function, 0 outside its cell."""
    at, u = locate(level_j, t)
    return np.where((at == cell) & (np.asarray(t) >= 0) & (np.asarray(t) <= 1), scale(level_j) * chebyshev_u(degree, u), 0.0)


def basis(level_j: int, modes: int, t: np.ndarray) -> np.ndarray:
    """All functions at t in [0, 1]: (2**J * modes) x len(t)."""
    t = np.atleast_1d(np.asarray(t, float))
    if ((t < 0) | (t > 1)).any():
        raise ValueError("t must lie in [0, 1]")
    cell, u = locate(level_j, t)
    out = np.zeros(((1 << level_j) * modes, len(t)))
    for m in range(modes):
        out[cell * modes + m, np.arange(len(t))] = scale(level_j) * chebyshev_u(m, u)
    return out


def cell_weight(u: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 1 - np.asarray(u, float) ** 2))


def quadrature(order: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and weights for the weight sqrt(1 - x**2)."""
    a = np.arange(1, order + 1) * math.pi / (order + 1)
    return np.cos(a), math.pi / (order + 1) * np.sin(a) ** 2


def expand(f, level_j: int, modes: int) -> np.ndarray:
    """Coefficients of f on [0, 1], f vectorised."""
    x, w = quadrature(modes + 8)
    out = np.zeros((1 << level_j, modes))
    for n in range(1 << level_j):
        v = np.asarray(f((x + 2 * n + 1) / 2 ** (level_j + 1)), float)
        if v.shape != x.shape or not np.isfinite(v).all():
            raise ValueError("f must return a finite value for each node")
        out[n] = scale(level_j) / 2 ** (level_j + 1) * u_table(modes, x) @ (w * v)
    return out.ravel()


def integration_blocks(level_j: int, modes: int) -> tuple[np.ndarray, np.ndarray]:
    """(own cell, later cells) blocks of the integration operator."""
    own, later = np.zeros((modes, modes)), np.zeros((modes, modes))
    for m in range(modes):
        if m % 2 == 0:
            later[m, 0] = 1 / (2**level_j * (m + 1))
        own[m, 0] += (-1) ** m / (2 ** (level_j + 1) * (m + 1))
        if m:
            own[m, m - 1] -= 1 / (2 ** (level_j + 2) * (m + 1))
        if m + 1 < modes:
            own[m, m + 1] += 1 / (2 ** (level_j + 2) * (m + 1))
    return own, later


def integration_matrix(level_j: int, modes: int, most: int = 4096) -> np.ndarray:
    """Dense; beyond `most` rows use the COO table or apply_integration."""
    n = 1 << level_j
    if n * modes > most:
        raise MemoryError("too large for a dense matrix")
    own, later = integration_blocks(level_j, modes)
    return np.kron(np.eye(n), own) + np.kron(np.triu(np.ones((n, n)), 1), later)


def linearization(modes: int) -> np.ndarray:
    """L[l, j, i] = 1 where U_i is part of U_l U_j."""
    l, j, i = np.indices((modes, modes, modes))
    return ((np.abs(l - j) <= i) & (i <= l + j) & ((i + l + j) % 2 == 0)).astype(float)


def product_blocks(level_j: int, coefficients: np.ndarray, modes: int) -> np.ndarray:
    """One block a cell: multiplication by the function with these coefficients."""
    c = np.asarray(coefficients, float).reshape(1 << level_j, modes)
    return scale(level_j) * np.einsum("nl,lji->nij", c, linearization(modes))


def product_matrix(level_j: int, coefficients: np.ndarray, modes: int) -> np.ndarray:
    blocks = product_blocks(level_j, coefficients, modes)
    n = len(blocks)
    out = np.zeros((n * modes, n * modes))
    for k, b in enumerate(blocks):
        out[k * modes : (k + 1) * modes, k * modes : (k + 1) * modes] = b
    return out


def differentiation_block(level_j: int, modes: int) -> np.ndarray:
    d = np.zeros((modes, modes))
    for m in range(modes):
        for j in range(m - 1, -1, -2):
            d[m, j] = 2 ** (level_j + 1) * 2 * (j + 1)
    return d


def solve_linear_ode(level_j: int, modes: int, a, forcing, y0: float = 0.0) -> np.ndarray:
    """Coefficients of y with y' + a(t) y = forcing(t), y(0) = y0; a is a number or a function."""
    p = integration_matrix(level_j, modes)
    e = expand(lambda t: np.asarray(forcing(t), float) * np.ones_like(t), level_j, modes)
    one = expand(np.ones_like, level_j, modes)
    by_a = product_matrix(level_j, expand(a, level_j, modes), modes) if callable(a) else a * np.eye(len(p))
    return np.linalg.solve(np.eye(len(p)) + p.T @ by_a.T, p.T @ e + y0 * one)


def projector(window: int, modes: int, level_j: int = 0, weighting: str = "uniform") -> np.ndarray:
    """Coefficients of a window's samples at equidistant times in [0, 1]: (2**J * modes) x window."""
    n = (1 << level_j) * modes
    if window < n:
        raise ValueError("the window must hold at least as many samples as there are coefficients")
    tau = np.linspace(0, 1, window)
    if weighting == "uniform":
        return np.linalg.pinv(basis(level_j, modes, tau).T)
    if weighting != "chebyshev":
        raise ValueError("weighting is uniform or chebyshev")
    x, w = quadrature(max(modes + 8, -(-2 * window // (1 << level_j))))
    out = np.zeros((n, window))
    for cell in range(1 << level_j):
        t = (x + 2 * cell + 1) / 2 ** (level_j + 1)
        at = np.clip(np.searchsorted(tau, t, "right") - 1, 0, window - 2)
        part = (t - tau[at]) / (tau[at + 1] - tau[at])
        lerp = np.zeros((len(t), window))
        lerp[np.arange(len(t)), at] += 1 - part
        lerp[np.arange(len(t)), at + 1] += part
        out[cell * modes : (cell + 1) * modes] = scale(level_j) / 2 ** (level_j + 1) * (u_table(modes, x) * w) @ lerp
    return out


def signal_projector(window: int, modes: int) -> np.ndarray:
    """Coefficients in plain U_m on [-1, 1]: modes x window."""
    if not 1 <= modes <= window:
        raise ValueError("modes must lie between 1 and the window")
    return np.linalg.pinv(u_table(modes, np.linspace(-1, 1, window)).T)


def edge_weights(window: int, modes: int, level_j: int = 0, weighting: str = "uniform") -> tuple[np.ndarray, np.ndarray]:
    """(projector, weights of the value, first and second derivative at the right end), each a vector over the window."""
    a = projector(window, modes, level_j, weighting)
    d = np.kron(np.eye(1 << level_j), differentiation_block(level_j, modes))
    edge = basis(level_j, modes, np.array([1 - EPS]))[:, 0]
    return a, np.array([edge @ a, edge @ d.T @ a, edge @ d.T @ d.T @ a])


def chebyshev_t(degree: int, x: np.ndarray | float) -> np.ndarray:
    """T_degree(x) by the three-term recurrence."""
    x = np.asarray(x, float)
    if not degree:
        return np.ones_like(x)
    before, now = np.ones_like(x), x
    for _ in range(degree - 1):
        before, now = now, 2 * x * now - before
    return now


def antiderivative(level_j: int, modes: int, t: np.ndarray) -> np.ndarray:
    """The integrals from 0 to t of all functions, exactly: (2**J * modes) x len(t). Within its cell that of U_m is (T_(m+1)(u) - T_(m+1)(-1)) / (m + 1)."""
    t = np.atleast_1d(np.asarray(t, float))
    at, u = locate(level_j, t)
    out = np.zeros(((1 << level_j) * modes, len(t)))
    factor = scale(level_j) / 2 ** (level_j + 1)
    for cell in range(1 << level_j):
        inside = np.where(at == cell, u, np.where(at > cell, 1.0, -1.0))
        for m in range(modes):
            out[cell * modes + m] = factor * (chebyshev_t(m + 1, inside) - (-1) ** (m + 1)) / (m + 1)
    return out
