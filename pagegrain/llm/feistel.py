"""A keyed Feistel permutation of 0..n-1 as a column expression, by cycle-walking.

The domain is Z_a x Z_b with a = ceil(sqrt n) and b = ceil(n / a), so fewer than a of its a*b points
lie outside 0..n-1 and a walk almost always ends at its first step.
"""

from __future__ import annotations

ROUNDS = 4


def _pass(x: str, a: str, b: str, key: str) -> str:
    """One pass over Z_a x Z_b; each half gets a keyed hash of the other added, in turn."""
    left, right = f"(({x}) div {b})", f"(({x}) % {b})"
    steps = f"named_struct('l', {left}, 'r', {right})"
    for k in range(ROUNDS):
        if k % 2 == 0:
            steps = f"transform(array({steps}), s -> named_struct('l', pmod(s.l + pmod(xxhash64(s.r, {key}, {k}), {a}), {a}), 'r', s.r))[0]"
        else:
            steps = f"transform(array({steps}), s -> named_struct('l', s.l, 'r', pmod(s.r + pmod(xxhash64(s.l, {key}, {k}), {b}), {b})))[0]"
    return f"transform(array({steps}), s -> s.l * {b} + s.r)[0]"


def permuted(x: str, n: str, key: str) -> str:
    """SQL for the place of x (0 <= x < n) under the permutation that key picks; x, n and key are SQL
    of bigints, n may be a column. n < 2 gives x. A walk visits at most a*b - n points outside, so its
    bounded loop always ends inside 0..n-1."""
    a, b = f"cast(ceil(sqrt(cast({n} as double))) as bigint)", "d.b"
    domain = f"named_struct('x', cast({x} as bigint), 'n', cast({n} as bigint), 'k', cast({key} as bigint), 'a', greatest({a}, 1L), 'b', cast(ceil({n} / greatest({a}, 1L)) as bigint))"
    once = lambda y: _pass(y, "d.a", b, "d.k")
    walk = f"aggregate(sequence(0L, d.a * d.b - d.n), p.y, (y, i) -> if(y < d.n, y, {once('y')}))"
    return (
        f"transform(array({domain}), d -> if(d.n < 2, d.x, transform(array(named_struct('y', {once('d.x')})), "
        f"p -> if(p.y < d.n, p.y, {walk}))[0]))[0]"
    )
