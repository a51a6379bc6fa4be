import numpy as np

from voxlake.operators.surface import _inside, sphere_points


def test_points_at_the_limit_are_decided_by_their_distance():
    rng = np.random.default_rng(5)
    spots = np.array(sphere_points(92))
    delta = rng.uniform(-4, 4, (3000, 3))
    radius, reach = rng.choice([2.9, 3.1, 3.2], 3000), rng.choice([2.9, 3.1, 3.2], 3000)
    # the second sphere passes through a point of the first, as near as rounding allows
    for i in range(1000):
        d = spots[i % 92] * radius[i] + delta[i]
        reach[i] = np.sqrt(d @ d)
    d = [spots[:, k][None, :] * radius[:, None] + delta[:, k][:, None] for k in range(3)]
    want = d[0] * d[0] + d[1] * d[1] + d[2] * d[2] < (reach * reach)[:, None]
    assert (_inside(delta, radius, reach, spots) == want).all()
