from decimal import Decimal

import pytest

from kinfold.config import Parameters, parse_parameters, summary


def test_reads_until_the_first_blank_line():
    p = parse_parameters("# a comment\nbeta=6\nsigma = 9\nmu=0.6\nexcludeNumericBlocks=False\n\nbeta=3\n")
    assert (p.beta, p.sigma, p.mu, p.excludeNumericBlocks) == (6, 9, Decimal("0.6"), False)
    assert ("beta", "6") in summary(p)


@pytest.mark.parametrize(
    "text",
    ["nosuch=1", "beta", "beta=x", "hasHeader=yes", "mu=abc", "beta=1", "beta=5\nsigma=5", "mu=0", "epsilon=1.5", "muIterate=2", "delimiter=#", "tokenizerType=Other", "comparator=Other", "minFreqStdToken=2\nmaxFreqErrToken=2"],
)
def test_rejects(text):
    with pytest.raises(ValueError):
        parse_parameters(text)


def test_tab_and_unused():
    assert Parameters(delimiter="TAB").separator == "\t"
    with pytest.warns(UserWarning):
        parse_parameters("runGlobalCorrection=True\n")
