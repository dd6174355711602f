"""The filter of ridges against convolution tap by tap."""

import time

import numpy as np
import pytest

from linemetry.operators.segment import filtered, gaussian


def by_taps(image, down, along):
    out = image
    for axis, taps in ((0, down), (1, along)):
        half, length = len(taps) // 2, out.shape[axis]
        wide = np.pad(out, [(half, half) if a == axis else (0, 0) for a in (0, 1)], mode="reflect") if length > 1 else np.repeat(out, 2 * half + 1, axis=axis)
        out = sum(t * (wide[i : i + length] if axis == 0 else wide[:, i : i + length]) for i, t in enumerate(taps[::-1]))
    return out


@pytest.mark.parametrize("shape", [(512, 512), (130, 64), (65, 1), (1, 40), (7, 3), (1, 1)])
def test_filter_is_convolution_with_mirrored_edges(shape):
    image = np.random.default_rng(1).random(shape) * 255
    for down, along in ((gaussian(2.0), gaussian(2.0, 1)), (gaussian(25.0, reach=3.0), gaussian(1.0, 2))):
        assert np.allclose(filtered(image, down, along), by_taps(image, down, along), rtol=0, atol=1e-9)


def test_what_is_not_finite_stays_within_reach():
    image = np.ones((200, 200))
    image[100, 100] = np.nan
    found = np.argwhere(np.isnan(filtered(image, gaussian(1.0), gaussian(1.0))))
    assert found.min() == 96 and found.max() == 104 and len(found) == 81


def test_a_wide_filter_takes_less_than_half_of_the_time_of_taps():
    image, taps = np.random.default_rng(2).random((512, 512)), gaussian(25.0, reach=3.0)

    def took(f):
        began = time.perf_counter()
        f(image, taps, taps)
        return time.perf_counter() - began

    assert min(took(filtered) for _ in range(5)) < 0.5 * min(took(by_taps) for _ in range(3))
