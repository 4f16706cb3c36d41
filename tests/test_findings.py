import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.operators import extraction as X
from tessera.operators import findings as N

TERMS = ["夹杂", "气孔", "疏松", "crack", "porosity", "corrosion"]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("源区附近未见夹杂、气孔和疏松等冶金缺陷", ["negative"] * 3),
        ("发现夹杂。未见气孔", ["positive", "negative"]),
        ("未见夹杂，但检测到气孔", ["negative", "positive"]),
        ("可能存在气孔", ["neutral"]),
        ("疑似夹杂，未见疏松", ["neutral", "neutral"]),
        ("夹杂不存在", ["negative"]),
        ("夹杂和气孔已排除；疏松存在", ["negative", "negative", "positive"]),
        ("No crack, porosity or corrosion was found, however corrosion is near", ["negative", "negative", "negative", "positive"]),
        ("not without crack", ["positive"]),
        ("The crack was ruled out", ["negative"]),
        ("Corrosion is absent but porosity is not", ["negative", "positive"]),
        ("north of the crack", ["positive"]),
        ("no " + "word " * N.WINDOW + "crack", ["positive"]),
        ("no " + "word " * (N.WINDOW - 1) + "crack and porosity", ["negative", "negative"]),
        ("", []),
    ],
)
def test_polarity(spark, text, want):
    rows = N.findings(spark.createDataFrame([(1, text), (2, None)], "id int, text string"), TERMS).orderBy("place").collect()
    assert [r.polarity for r in rows] == want


def loop(text, terms, cues, window):
    """The same told as a loop over tokens."""
    pattern = N._either([w.lower() for w in {*terms, *cues.negative, *cues.behind, *cues.doubt, *cues.ends}])
    out, open_, no, doubt, left = [], [], 0, False, 0
    for place, t in enumerate(re.findall(rf"(?:{pattern}|{N.STOPS}|[一-鿿]|[^\W_]+)", text.lower())):
        if left <= 0:
            no, doubt = 0, False
        if re.fullmatch(N.STOPS, t) or t in cues.ends:
            out, open_, no, doubt, left = out + open_, [], 0, False, 0
        elif t in cues.behind and any(p is None for _, p, _ in open_):
            open_ = [(w, p or "negative", k) for w, p, k in open_]
            no, doubt, left = 0, False, 0
        elif t in cues.negative:
            no, left = no + 1, window
        elif t in cues.doubt:
            doubt, left = True, window
        elif t in terms:
            open_.append((t, "neutral" if doubt else "negative" if no % 2 else "positive" if no else None, place))
            left = window if left > 0 else 0
        else:
            left = max(left - 1, 0)
    return [(w, p or "positive", k) for w, p, k in out + open_]


def test_polarity_against_a_loop(spark):
    rnd = random.Random(3)
    words = ["未见", "夹杂", "气孔", "和", "不存在", "可能", "但", "。", "no", "not", "crack", "however", "absent", "ruled out", "word", "、", "thing", ". ", "porosity", "may", "被排除"]
    texts = [(k, "".join(rnd.choice(words) + rnd.choice([" ", " ", ""]) for _ in range(rnd.choice([3, 12, 60])))) for k in range(250)]
    for window in (2, N.WINDOW):
        got = {}
        for r in N.findings(spark.createDataFrame(texts, "id int, text string"), TERMS, window=window).orderBy("id", "place").collect():
            got.setdefault(r.id, []).append((r.term, r.polarity, r.place))
        for k, t in texts:
            assert got.get(k, []) == loop(t, TERMS, N.CUES, window), t


def test_findings_support_causes_or_rule_them_out(spark):
    found = spark.createDataFrame([(1, "F1", "crack", "negative"), (1, "F2", "porosity", "positive"), (1, "F3", "corrosion", "neutral"), (2, "F1", "crack", "positive")], "doc int, key string, term string, polarity string")
    causes = spark.createDataFrame([(1, "C1", "crack"), (1, "C2", "porosity"), (1, "C3", "corrosion"), (1, "C4", "crack")], "doc int, key string, term string")
    assert {(r.doc, r.from_key, r.rel_type, r.to_key) for r in N.evidence_edges(found, causes).collect()} == {(1, "F1", "RULES_OUT", "C1"), (1, "F1", "RULES_OUT", "C4"), (1, "F2", "SUPPORTS", "C2")}


def test_rows_are_retried_and_fall_back(spark):
    class Flaky:
        name = "flaky"

        def __init__(self):
            self.calls = {}

        def complete(self, text):
            n = self.calls[text] = self.calls.get(text, 0) + 1
            if text.startswith("busy") and n < 3:
                raise X.Transient("later")
            if text.startswith("never"):
                raise X.Transient("always")
            if text.startswith("bad"):
                raise ValueError("x" * 5000)
            return {"text": text, "n": n}

    rows = [(1, "good"), (2, "busy 1"), (3, "never FS-1"), (4, "bad"), (5, "bad FS-22"), (6, None)]
    got = {r.id: r for r in X.extracted(spark.createDataFrame(rows, "id int, text string"), [Flaky(), X.PatternExtractor("ids", {"id": r"FS-(\d+)"})], backoff=0.0).collect()}
    told = {i: (r.payload, r.extractor, r.attempts) for i, r in got.items()}
    assert told[1] == ('{"n": 1, "text": "good"}', "flaky", 1) and told[2] == ('{"n": 3, "text": "busy 1"}', "flaky", 3)
    assert told[3] == ('{"id": "1"}', "ids", 4) and told[5] == ('{"id": "22"}', "ids", 2) and told[6][1] == "flaky"
    assert got[4].payload is None and got[4].attempts == 2 and got[4].error == "ids: ValueError: no id"
    alone = X.extracted(spark.createDataFrame(rows[3:4], "id int, text string"), [Flaky()], backoff=0.0).first()
    assert alone.payload is None and len(alone.error) == X.MOST_ERROR and X.extracted(spark.createDataFrame(rows, "id int, text string"), []).where(F.col("error") == "no extractor").count() == 6
