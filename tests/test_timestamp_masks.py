"""Values that share a mask but not a parser, or that no parser reads."""

import pandas as pd

from verbatrix.operators.timestamps import parse_moments, shape_mask

UNREADABLE = "5 weeks to March 2024, 10:00"
SPANISH = "5 de marzo de 2024, 10:00"


def moments(values):
    return parse_moments(pd.Series(values), pd.Series(["Europe/Madrid"] * len(values))).tolist()


def test_unreadable_values_before_a_readable_one_of_their_mask():
    assert shape_mask(UNREADABLE) == shape_mask(SPANISH)
    alone = moments([SPANISH])[0]
    assert alone == 1709629200
    for n in (1, 5, 50):
        assert moments([UNREADABLE] * n + [SPANISH])[-1] == alone and moments([SPANISH] + [UNREADABLE] * n)[0] == alone


def test_every_parser_below_one_mask_reads_its_values():
    # zone names of up to five letters and words that name none share a mask
    pair = ["2024-03-05 10:00 abcdefg", "2024-03-05 10:00 UTC"]
    assert len({shape_mask(v) for v in pair}) == 1
    assert moments(pair * 6)[1::2] == moments([pair[1]] * 6) == [1709632800] * 6
    assert all(v is pd.NA for v in moments(pair * 6)[::2])
