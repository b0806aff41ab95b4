"""The trained scorer: columns it has not seen, headers, and how sure it may be."""

from __future__ import annotations

import datetime
import random

import numpy as np
import pytest

from maskloom.operators import detect, learned
from workload import inputs
from workload.queries import QUERIES

SF = "/root/testdata/sf0.001"


def hidden_columns(rng):
    """Columns whose words and formats the training doesn't draw, or draws otherwise."""
    first, last = "Dagny Piet Rosalind Mateus Ondine Cyril Tamsin Wendel".split(), "Abbott Lindqvist Ferreira Galloway Horvat Pemberton Quist".split()
    shops = ["CORNER BEAN {}", "Lakeside Bikes #{}", "PAPERWEIGHT*Shop {}", "Old Mill Cheese {}"]
    day = lambda: datetime.date(2015, 1, 1) + datetime.timedelta(days=rng.randrange(3000))
    return {
        "name": [
            lambda: f"{rng.choice(first)} {rng.choice(last)}", lambda: f"{rng.choice(last)}, {rng.choice(first)}", lambda: f"{rng.choice(first)} {rng.choice(last)}".upper(),
            lambda: f"{rng.choice(first)[0]}. {rng.choice(last)}",
        ],
        "email": [lambda: f"{rng.choice(first).lower()}@{rng.choice(last).lower()}.dev", lambda: f"{rng.randint(1, 999)}.{rng.choice(last)}@post.example.org"],
        "date": [
            lambda: day().strftime("%B %-d, %Y"), lambda: day().strftime("%d-%b-%Y"), lambda: day().strftime("%d/%m/%Y"), lambda: day().strftime("%Y-%m-%d 07:15:09"),
            lambda: day().strftime("%m-%d-%Y"), lambda: day().strftime("%d.%m.%Y"),
        ],
        "amount": [lambda: f"${rng.uniform(1, 90_000):,.2f}", lambda: f"{rng.uniform(1, 900):.2f}".replace(".", ","), lambda: f"{rng.uniform(-900, 900):.2f}"],
        "id": [
            lambda: f"CUST{rng.randint(10**6, 10**7 - 1)}", lambda: f"{rng.getrandbits(32):08x}-{rng.getrandbits(16):04x}-4{rng.getrandbits(12):03x}-a{rng.getrandbits(12):03x}-{rng.getrandbits(48):012x}",
            lambda: f"INV-{rng.randint(1000, 99999)}", lambda: f"+49 {rng.randint(100, 999)} {rng.randint(100, 999)} {rng.randint(1000, 9999)}",
        ],
        "description": [lambda: rng.choice(shops).format(rng.randint(100, 9999)), lambda: f"{rng.choice(last)} {rng.choice(['Ltd', 'Group', 'Inc'])}"],
        "country": [lambda: rng.choice(["Peru", "Chad", "New Zealand", "Mali"]), lambda: rng.choice(["DE", "FR", "JP", "BR", "KE"])],
        "category": [lambda: rng.choice(["Food & Drink", "Travel", "Gifts & Donations", "Home"]), lambda: rng.choice(["Snacks", "Dairy", "Frozen", "Bakery"])],
        None: [
            lambda: rng.choice("ABCDEFG"), lambda: f"https://a.example/{rng.randint(1, 99)}", lambda: f"10.{rng.randint(0, 255)}.{rng.randint(0, 255)}.7",
            lambda: rng.choice(["0", "1"]), lambda: str(rng.randint(1, 10**6)),
        ],
    }


@pytest.mark.parametrize("size", [2, 10, 50])
def test_unseen_columns_have_no_wrong_type(size):
    rng, model = random.Random(size), learned.trained()
    right = total = 0
    for kind, makers in hidden_columns(rng).items():
        for make in makers:
            for header in ("", "col_3"):
                for _ in range(10):
                    found, sure = model.classify([make() for _ in range(size)], header)
                    assert found == kind or sure < detect.THRESHOLD, (kind, make(), header, found, sure)
                    right, total = right + (found == kind and (kind is None or sure >= detect.THRESHOLD)), total + 1
    assert right / total > 0.85


def test_headers_decide_where_values_do_not(spark):
    rng, model = random.Random(1), learned.trained()
    whole = [str(rng.randint(1, 10**5)) for _ in range(50)]
    assert model.classify(whole, "x")[0] is None
    assert model.classify(whole, "Amount") > ("amount", 0.8) and model.classify(whole, "Account No") > ("id", 0.8)
    letters = [rng.choice("ABCDEFGHIJ") for _ in range(50)]
    codes = [f"REF-{rng.randint(1000, 9999)}" for _ in range(50)]
    for header in ("Name", "email", "Country", "Date", "amount", "Description"):
        for values in (letters, codes):
            found, sure = model.classify(values, header)
            assert found in (None, "id") or sure < detect.THRESHOLD, (header, values[0], found, sure)


def test_probabilities_are_about_as_often_right():
    """Of answers given with 80 to 95 percent, no less than that many are right."""
    rng, model = np.random.default_rng(77), learned.trained()
    sure, right = [], []
    for kind, make in learned._styles():
        draw = make(rng)
        for size in (1, 2, 5, 20):
            found, p = model.classify([draw() for _ in range(size)], "")
            sure.append(p if found else 1.0)
            right.append((found or learned.NONE) == kind)
    sure, right = np.array(sure), np.array(right)
    assert right[sure >= 0.8].mean() > 0.97


def test_hard_columns_are_detected(spark):
    rows = {r["column"]: r for r in QUERIES["detect_trained"](spark, SF).collect()}
    assert {c: (r.type, r.status) for c, r in rows.items()} == {c: (t, "detected") for c, t in inputs.HARD_TYPES.items()}
    assert rows["days_first"].formats == "dd/MM/yyyy" and rows["stamped"].formats == "yyyy-MM-dd HH:mm" and rows["months_first"].formats is None
    assert [c for c, r in rows.items() if r.ambiguous] == ["unclear"]


def test_all_frames_meet_the_bar(spark):
    report = {r.part: r for r in QUERIES["detect_accuracy_trained"](spark, SF).collect()}
    assert report["core"].holds and report["ambiguous"].holds and report["core"].total == 2 * report["ambiguous"].total > 0


def test_empty_columns_and_tables(spark):
    df = spark.createDataFrame([(None, ""), (None, "")], "nothing STRING, blank STRING")
    found = {r["column"]: (r.type, r.status) for r in learned.propose(df).collect()}
    assert found["nothing"] == (None, "skipped") and found["blank"][1] == "skipped"
    assert learned.propose(df.where("false")).count() == 2
    assert learned.shape("March 5, 2024") == "Aa+_9,_9+" and learned.header_hints("customerName") == ["name"]
