"""One local session for all tests, and small tables with edge cases."""

from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from maskloom.session import local_session  # noqa: E402

PEOPLE_POLICY = {"name": "name", "email": "email", "country": "country"}


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, **{"spark.sql.shuffle.partitions": "4"})
    yield session
    session.stop()


def people(spark, rows):
    return spark.createDataFrame(rows, "name STRING, email STRING, country STRING")


@pytest.fixture
def policy():
    return dict(PEOPLE_POLICY)


@pytest.fixture
def small(spark):
    return people(spark, [(f"Guest {i:03d}", f"guest.{i}@mail.test", "NZ") for i in range(100)])


@pytest.fixture
def with_nulls(spark):
    return people(
        spark,
        [
            ("Ivo Brandt", None, "PT"),
            (None, "lena@mail.test", "NO"),
            ("Mara Lind", "mara@mail.test", None),
            ("Otto Falk", "otto@mail.test", "CL"),
            (None, None, None),
        ],
    )


@pytest.fixture
def colliding(spark):
    """One name under three addresses, one of them twice, and one address under three names."""
    shared = [(name, "front.office@mail.test", "IS") for name in ("Runa Berg", "Oda Berg", "Pal Dahl")]
    return people(spark, shared + [("Runa Berg", f"{box}@mail.test", "IS") for box in ("runa", "r.berg", "runa", "berg7")])


@pytest.fixture
def scripts(spark):
    """Two names that an accent tells apart, names in three scripts, one in two scripts, and one with a sign."""
    accent, plain = "Renée Faure", "Renee Faure"
    whole = ["Δήμος Ράλλης", "გიორგი ბერიძე", "अनिता राव"]
    names = [*whole, accent, plain, f"{whole[1]} {plain}", f"{plain} 🌊"]
    return people(spark, [(n, f"box{len(n)}.{i}@example.org", "GE") for i, n in enumerate(names)])


@pytest.fixture
def card_payments(spark):
    return spark.createDataFrame(
        [
            ("06/03/2024", "310.20", "NORTHERN FERRIES", "Travel"),
            ("07/28/2024", "-19.75", "RETURN CORNER BOOKS", "Shopping"),
            ("11/09/2024", "6.40", "BEAN AND LEAF", "Food & Drink"),
        ],
        "`Transaction Date` STRING, Amount STRING, Description STRING, Category STRING",
    )


@pytest.fixture
def card_policy():
    return {
        "Transaction Date": "date",
        "Amount": "amount",
        "Description": {"type": "description", "category_column": "Category"},
    }
