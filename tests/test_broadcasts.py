"""Tables of exploded words look as small as the files that they come from: none of them is broadcast."""

import re
from pathlib import Path

import pytest

from loreweave.plans import registry

SF = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="the driver's tables are not here")


def _broadcast_words(df) -> list[str]:
    """Lines of the plan where an explosion stands below a broadcast."""
    found, under = [], None
    for line in df._jdf.queryExecution().executedPlan().toString().splitlines():
        at = re.search(r"[A-Za-z]", line)
        if at is None:
            continue
        if under is not None and at.start() <= under:
            under = None
        if line[at.start() :].startswith("BroadcastExchange") and under is None:
            under = at.start()
        elif under is not None and line[at.start() :].startswith("Generate explode"):
            found.append(line.strip())
    return found


@pytest.mark.parametrize("name", ["confirmed_claims", "superseded_claims", "unbacked_claims"])
def test_exploded_words_are_not_broadcast(spark, name):
    assert _broadcast_words(registry.queries()[name](spark, str(SF))) == []
