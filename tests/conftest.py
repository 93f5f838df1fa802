import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tests.session import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return session()


@pytest.fixture
def toy_reviews(spark):
    rows = [
        (1, "P1", "t1", "Great taste, easy to swallow", " red ", "5", "2024-01-02"),
        (2, "C9 ", "t2", "Too bitter. 100% not worth it", "red", "2.0", "2024-01-20"),
        (3, "ZZ", "t3", None, "blue", "3", "bad"),
        (4, "C9", "t4", "Café  don't foo_bar taste", None, "n/a", "2024-02-01"),
        (5, "C9", "t5", "taste TASTE", "red", "4", "2024-02-03"),
    ]
    names = "row int, Asin string, Title string, Content string, Model string, Rating string, Date string"
    return spark.createDataFrame(rows, names)


@pytest.fixture
def toy_brands(spark):
    rows = [("C9", "Old", "PX", 1), ("C9", "Nine", "PX", 2), ("C1", "One", "P1", 3), ("C2", "Two", "P1", 4)]
    return spark.createDataFrame(rows, "ASIN string, Brand string, `Parent ASIN` string, ord int")


@pytest.fixture
def processed(toy_reviews, toy_brands):
    from shelfvoice.plans.pipelines import process_reviews

    return process_reviews(toy_reviews, toy_brands, order_by=["row"], brand_order=["ord"])
