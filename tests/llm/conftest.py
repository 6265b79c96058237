import random

import pytest


@pytest.fixture
def rng():
    return random.Random(5)


def with_clashes(df, *names):
    """Columns named as an operator's own results."""
    from pyspark.sql import functions as F

    return df.withColumns({n: F.lit("old") for n in names})
