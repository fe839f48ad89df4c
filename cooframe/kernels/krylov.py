"""Krylov methods on NumPy vectors; the matrix is a function, in one task or over the cluster.

Each returns (x, iterations, residual norm, converged) and stops at
|b - A x| <= max(atol, rtol |b|). ``M`` applies a preconditioner.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

Apply = Callable[[np.ndarray], np.ndarray]


def _start(A: Apply, b: np.ndarray, x0) -> tuple[np.ndarray, np.ndarray]:
    if x0 is None:
        return np.zeros_like(b), b.copy()
    x = np.array(x0, dtype=b.dtype)
    return x, b - A(x)


def _goal(b: np.ndarray, atol: float, rtol: float):
    return np.maximum(atol, rtol * np.linalg.norm(b, axis=0))


def _safe(a, b):
    """a / b, and 0 where b is 0 (a column that has converged exactly)."""
    return np.where(b == 0, 0, a / np.where(b == 0, 1, b))


def cg(A: Apply, b, M: Apply | None = None, x0=None, atol=1e-10, rtol=1e-6, maxiter=10_000):
    """Conjugate gradients; ``b`` may have many columns, which iterate together."""
    x, r = _start(A, b, x0)
    goal = _goal(b, atol, rtol)
    z = M(r) if M else r
    p, rz = z.copy(), np.sum(np.conj(r) * z, axis=0)
    it = 0
    while it < maxiter and np.any(np.linalg.norm(r, axis=0) > goal):
        q = A(p)
        alpha = _safe(rz, np.sum(np.conj(p) * q, axis=0))
        x = x + alpha * p
        r = r - alpha * q
        z = M(r) if M else r
        new = np.sum(np.conj(r) * z, axis=0)
        p = z + _safe(new, rz) * p
        rz = new
        it += 1
    size = np.linalg.norm(r, axis=0)
    return x, it, float(np.max(size, initial=0)), bool(np.all(size <= goal))


def pipelined_cg(A: Apply, b, M: Apply | None = None, x0=None, atol=1e-10, rtol=1e-6, maxiter=10_000):
    """CG in the form that needs one reduction an iteration."""
    x, r = _start(A, b, x0)
    goal = float(_goal(b, atol, rtol))
    u = M(r) if M else r.copy()
    w = A(u)
    p = s = None
    alpha = gamma = None
    it = 0
    while it < maxiter and np.linalg.norm(r) > goal:
        new, delta = np.vdot(r, u), np.vdot(w, u)
        if p is None:
            beta, step = 0.0, new / delta
            p, s = u.copy(), w.copy()
        else:
            beta = new / gamma
            step = new / (delta - beta * new / alpha)
            p, s = u + beta * p, w + beta * s
        gamma, alpha = new, step
        x = x + step * p
        r = r - step * s
        u = M(r) if M else r.copy()
        w = A(u)
        it += 1
    size = float(np.linalg.norm(b - A(x)))
    return x, it, size, bool(size <= 10 * goal + 1e-300)


def bicgstab(A: Apply, b, M: Apply | None = None, x0=None, atol=1e-10, rtol=1e-6, maxiter=10_000):
    x, r = _start(A, b, x0)
    goal = float(_goal(b, atol, rtol))
    shadow, rho, alpha, omega = r.copy(), 1.0, 1.0, 1.0
    v = p = np.zeros_like(b)
    it = 0
    while it < maxiter and np.linalg.norm(r) > goal:
        new = np.vdot(shadow, r)
        if abs(new) < 1e-300:
            shadow, new, p, v, rho, alpha, omega = r.copy(), np.vdot(r, r), np.zeros_like(b), np.zeros_like(b), 1.0, 1.0, 1.0
        p = r + (new / rho) * (alpha / omega) * (p - omega * v)
        y = M(p) if M else p
        v = A(y)
        alpha = new / np.vdot(shadow, v)
        s = r - alpha * v
        z = M(s) if M else s
        t = A(z)
        tt = np.vdot(t, t)
        omega = np.vdot(t, s) / tt if tt else 0.0
        x = x + alpha * y + omega * z
        r = s - omega * t
        rho = new
        it += 1
        if omega == 0:
            break
    size = float(np.linalg.norm(r))
    return x, it, size, size <= goal


def gmres(A: Apply, b, M: Apply | None = None, x0=None, atol=1e-10, rtol=1e-6, maxiter=10_000, restart=30, flexible=False):
    """Right-preconditioned GMRES(restart); ``maxiter`` counts inner steps. ``flexible`` keeps preconditioned vectors, so M may vary."""
    x, r = _start(A, b, x0)
    goal = float(_goal(b, atol, rtol))
    it = 0
    while True:
        beta = np.linalg.norm(r)
        if beta <= goal or it >= maxiter:
            return x, it, float(beta), bool(beta <= goal)
        V, Z, H = [r / beta], [], np.zeros((restart + 1, restart), b.dtype)
        k = 0
        for k in range(restart):
            z = M(V[k]) if M else V[k]
            Z.append(z)
            w = A(z)
            for j in range(k + 1):
                H[j, k] = np.vdot(V[j], w)
                w = w - H[j, k] * V[j]
            H[k + 1, k] = np.linalg.norm(w)
            it += 1
            e = np.zeros(k + 2, b.dtype)
            e[0] = beta
            y, *_ = np.linalg.lstsq(H[: k + 2, : k + 1], e, rcond=None)
            left = np.linalg.norm(e - H[: k + 2, : k + 1] @ y)
            if left <= goal or abs(H[k + 1, k]) < 1e-300 or it >= maxiter:
                break
            V.append(w / H[k + 1, k])
        if flexible or not M:
            x = x + sum(c * z for c, z in zip(y, Z))
        else:
            x = x + M(sum(c * v for c, v in zip(y, V)))
        r = b - A(x)
        if abs(H[k + 1, k]) < 1e-300:
            size = float(np.linalg.norm(r))
            return x, it, size, size <= goal


def fgmres(*args, **kwargs):
    return gmres(*args, flexible=True, **kwargs)


def minres(A: Apply, b, M: Apply | None = None, x0=None, atol=1e-10, rtol=1e-6, maxiter=10_000):
    """For symmetric matrices, definite or not; M must be positive definite."""
    x, r1 = _start(A, b, x0)
    goal = float(_goal(b, atol, rtol))
    y = M(r1) if M else r1.copy()
    beta1 = np.sqrt(abs(np.vdot(r1, y).real))
    if beta1 == 0:
        return x, 0, 0.0, True
    old, beta, dbar, eps, phibar, cs, sn = 0.0, beta1, 0.0, 0.0, beta1, -1.0, 0.0
    w = w2 = np.zeros_like(b)
    r2 = r1
    it = 0
    while it < maxiter:
        it += 1
        v = y / beta
        y = A(v)
        if it >= 2:
            y = y - (beta / old) * r1
        alfa = np.vdot(v, y).real
        y = y - (alfa / beta) * r2
        r1, r2 = r2, y
        y = M(r2) if M else r2.copy()
        old, beta = beta, np.sqrt(abs(np.vdot(r2, y).real))
        oldeps = eps
        delta, gbar = cs * dbar + sn * alfa, sn * dbar - cs * alfa
        eps, dbar = sn * beta, -cs * beta
        gamma = max(np.hypot(gbar, beta), 1e-300)
        cs, sn = gbar / gamma, beta / gamma
        phi, phibar = cs * phibar, sn * phibar
        w1, w2 = w2, w
        w = (v - oldeps * w1 - delta * w2) / gamma
        x = x + phi * w
        if abs(phibar) <= (goal if not M else 0.1 * goal) or beta < 1e-300:
            break
    size = float(np.linalg.norm(b - A(x)))
    return x, it, size, size <= goal * (1 + 1e-6) or abs(phibar) <= goal


def _bidiagonal(A: Apply, At: Apply, b):
    beta = np.linalg.norm(b)
    u = b / beta if beta else b
    v = At(u)
    alfa = np.linalg.norm(v)
    return u, beta, (v / alfa if alfa else v), alfa


def lsqr(A: Apply, At: Apply, b, n: int, atol=1e-8, btol=1e-8, maxiter=10_000, damp=0.0, conlim=1e8):
    """Least squares min |A x - b|^2 + damp^2 |x|^2; rectangular matrices."""
    u, beta, v, alfa = _bidiagonal(A, At, b)
    x = np.zeros(n, v.dtype)
    if beta == 0 or alfa == 0:
        return x, 0, float(beta), True
    w, phibar, rhobar, bnorm, anorm, ddnorm, res2 = v.copy(), beta, alfa, beta, 0.0, 0.0, 0.0
    for it in range(1, maxiter + 1):
        u = A(v) - alfa * u
        beta = np.linalg.norm(u)
        if beta:
            u = u / beta
            anorm = np.sqrt(anorm**2 + alfa**2 + beta**2 + damp**2)
            v = At(u) - beta * v
            alfa = np.linalg.norm(v)
            v = v / alfa if alfa else v
        rho1 = np.hypot(rhobar, damp)
        c1, psi = rhobar / rho1, damp / rho1 * phibar
        phibar = c1 * phibar
        rho = np.hypot(rho1, beta)
        c, s = rho1 / rho, beta / rho
        theta, rhobar, phi, phibar = s * alfa, -c * alfa, c * phibar, s * phibar
        ddnorm += np.linalg.norm(w / rho) ** 2
        x = x + (phi / rho) * w
        w = v - (theta / rho) * w
        res2 += psi**2
        rnorm, arnorm = np.sqrt(phibar**2 + res2), alfa * abs(s * phi)
        stop1, stop2 = rnorm / bnorm, arnorm / (anorm * rnorm) if anorm * rnorm else 0.0
        if stop2 <= atol or stop1 <= btol + atol * anorm * np.linalg.norm(x) / bnorm:
            return x, it, float(rnorm), True
        if anorm * np.sqrt(ddnorm) >= conlim:
            return x, it, float(rnorm), False
    return x, maxiter, float(rnorm), False


def lsmr(A: Apply, At: Apply, b, n: int, atol=1e-8, btol=1e-8, maxiter=10_000, damp=0.0, conlim=1e8):
    """As lsqr, with |A^T r| falling at every step."""
    u, beta, v, alfa = _bidiagonal(A, At, b)
    x = np.zeros(n, v.dtype)
    if alfa * beta == 0:
        return x, 0, float(beta), True
    zetabar, alphabar, rho, rhobar, cbar, sbar = alfa * beta, alfa, 1.0, 1.0, 1.0, 0.0
    h, hbar, bnorm, anorm2 = v.copy(), np.zeros_like(x), np.linalg.norm(b), alfa**2
    for it in range(1, maxiter + 1):
        u = A(v) - alfa * u
        beta = np.linalg.norm(u)
        if beta:
            u = u / beta
            v = At(u) - beta * v
            alfa = np.linalg.norm(v)
            v = v / alfa if alfa else v
        alphahat = np.hypot(alphabar, damp)
        rhoold = rho
        rho = np.hypot(alphahat, beta)
        c, s = alphahat / rho, beta / rho
        theta, alphabar = s * alfa, c * alfa
        rhobarold, thetabar, rhotemp = rhobar, sbar * rho, cbar * rho
        rhobar = np.hypot(cbar * rho, theta)
        cbar, sbar = rhotemp / rhobar, theta / rhobar
        zeta, zetabar = cbar * zetabar, -sbar * zetabar
        hbar = h - (thetabar * rho / (rhoold * rhobarold)) * hbar
        x = x + (zeta / (rho * rhobar)) * hbar
        h = v - (theta / rho) * h
        anorm2 += beta**2 + alfa**2
        r = b - A(x)
        rnorm = float(np.hypot(np.linalg.norm(r), damp * np.linalg.norm(x)))
        anorm = np.sqrt(anorm2)
        if abs(zetabar) <= atol * anorm * max(rnorm, 1e-300) or rnorm <= btol * bnorm + atol * anorm * np.linalg.norm(x):
            return x, it, rnorm, True
    return x, maxiter, rnorm, False


def mixed_cg(A: Apply, b, M: Apply | None = None, x0=None, atol=1e-10, rtol=1e-6, maxiter=10_000):
    """CG on single-precision vectors, refined by residuals in double precision."""
    x, r = _start(A, b, x0)
    goal = float(_goal(b, atol, rtol))
    it, size = 0, float(np.linalg.norm(r))
    single = lambda f: (lambda v: f(v.astype(np.float64)).astype(np.float32)) if f else None
    while size > goal and it < maxiter:
        d, steps, _, _ = cg(single(A), (r / size).astype(np.float32), single(M), None, 0.0, max(1e-4, 0.5 * goal / size), maxiter - it)
        new = x + size * d.astype(np.float64)
        r = b - A(new)
        it += max(1, steps)
        if np.linalg.norm(r) >= size:
            break
        x, size = new, float(np.linalg.norm(r))
    return x, it, size, size <= goal


def subspace_svd(A: Apply, At: Apply, n: int, k: int, maxiter: int = 200, tol: float = 1e-10, seed: int = 0):
    """(u, s, v) for the k largest singular values, by power iteration on a block with products only."""
    v = orthonormal(np.random.default_rng(seed).standard_normal((n, min(n, 2 * k + 2))))
    before = None
    for _ in range(maxiter):
        u, _ = np.linalg.qr(A(v))
        v, r = np.linalg.qr(At(u))
        s = np.linalg.svd(r, compute_uv=False)[:k]
        if before is not None and np.all(np.abs(s - before) <= tol * s.max(initial=1e-300)):
            break
        before = s
    p, s, qt = np.linalg.svd(A(v), full_matrices=False)
    return p[:, :k], s[:k], (v @ qt.T)[:, :k]


METHODS = {"cg": cg, "mixed_cg": mixed_cg, "pipelined_cg": pipelined_cg, "bicgstab": bicgstab, "gmres": gmres, "fgmres": fgmres, "minres": minres}
LEAST_SQUARES = {"lsqr": lsqr, "lsmr": lsmr}


def lanczos_log_quadrature(A: Apply, z: np.ndarray, steps: int) -> float:
    """z^T log(A) z by Gauss quadrature from Lanczos steps that start at z."""
    size = np.linalg.norm(z)
    basis, alphas, betas = [z / size], [], []
    for k in range(min(steps, len(z))):
        w = A(basis[k])
        alphas.append(float(np.vdot(basis[k], w).real))
        for v in basis:  # full reorthogonalisation
            w = w - np.vdot(v, w) * v
        beta = float(np.linalg.norm(w))
        if beta < 1e-12:
            break
        betas.append(beta)
        basis.append(w / beta)
    k = len(alphas)
    theta, q = np.linalg.eigh(np.diag(alphas) + np.diag(betas[: k - 1], 1) + np.diag(betas[: k - 1], -1))
    return float(size**2 * np.sum(q[0] ** 2 * np.log(np.maximum(theta, 1e-300))))


def hutchinson_logdet(A: Apply, n: int, probes: int = 20, steps: int = 30, seed: int = 0) -> float:
    """log det of a positive definite matrix: the mean over random sign vectors, drawn from the seed alone."""
    rng = np.random.default_rng(seed)
    return float(np.mean([lanczos_log_quadrature(A, rng.integers(0, 2, n) * 2.0 - 1.0, steps) for _ in range(probes)]))


def orthonormal(z: np.ndarray) -> np.ndarray:
    q, r = np.linalg.qr(z)
    size = np.abs(np.diag(r))
    return q[:, size > 1e-12 * max(size.max(initial=0), 1e-300)]


def lobpcg(A: Apply, n: int, k: int, M: Apply | None = None, largest: bool = True, tol: float = 1e-8, maxiter: int = 1000, seed: int = 0):
    """k extremal eigenpairs of a symmetric matrix: (values, vectors, iterations, converged)."""
    x = orthonormal(np.random.default_rng(seed).standard_normal((n, min(n, k + 2))))
    p = None
    order = slice(None, None, -1) if largest else slice(None)
    values = np.zeros(0)
    for it in range(1, maxiter + 1):
        ax = A(x)
        t, c = np.linalg.eigh(x.T @ ax)
        values, x, ax = t[order], x @ c[:, order], ax @ c[:, order]
        r = ax - x * values
        if np.all(np.linalg.norm(r[:, :k], axis=0) <= tol * np.maximum(1, np.abs(values[:k]))):
            return values[:k], x[:, :k], it, True
        w = M(r) if M else r
        s = orthonormal(np.hstack([x, w] if p is None else [x, w, p]))
        t, c = np.linalg.eigh(s.T @ A(s))
        take = c[:, order][:, : x.shape[1]]
        new = s @ take
        p = new - x @ (x.T @ new)
        norms = np.linalg.norm(p, axis=0)
        p = p[:, norms > 1e-14]
        p = p if p.shape[1] else None
        x = orthonormal(new)
    return values[:k], x[:, :k], maxiter, False


def lanczos(matvec, n: int, k: int, pick, dtype=float, seed: int = 0, tol: float = 1e-10) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues that ``pick`` chooses, with vectors, of a Hermitian operator; all steps stay orthogonal, and are more until the residuals are small."""
    rng = np.random.default_rng(seed)
    steps = min(n, 2 * k + 40)
    while True:
        q = np.zeros((n, steps + 1), np.result_type(dtype, float))
        alpha, beta = np.zeros(steps), np.zeros(steps)
        q[:, 0] = rng.standard_normal(n)
        q[:, 0] /= np.linalg.norm(q[:, 0])
        for j in range(steps):
            w = matvec(q[:, j])
            alpha[j] = np.real(np.vdot(q[:, j], w))
            for _ in range(2):
                w = w - q[:, : j + 1] @ (np.conj(q[:, : j + 1].T) @ w)
            beta[j] = np.linalg.norm(w)
            if beta[j] <= 1e-14 * max(1.0, abs(alpha[j])):  # an invariant space: go on in what is left
                w, beta[j] = rng.standard_normal(n), 0.0
                for _ in range(2):
                    w = w - q[:, : j + 1] @ (np.conj(q[:, : j + 1].T) @ w)
            q[:, j + 1] = w / max(np.linalg.norm(w), 1e-300)
        values, s = np.linalg.eigh(np.diag(alpha) + np.diag(beta[:-1], 1) + np.diag(beta[:-1], -1))
        at = pick(values)
        if steps == n or np.all(np.abs(beta[-1] * s[-1, at]) <= tol * max(1e-300, np.abs(values).max())):
            return values[at], q[:, :steps] @ s[:, at]
        if steps >= min(n, 1500):
            raise RuntimeError("Lanczos steps did not converge; take sigma")
        steps = min(n, 2 * steps, 1500)
