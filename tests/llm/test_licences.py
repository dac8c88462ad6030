import math
import re

from panelsplit.llm.common import table
from panelsplit.llm.licences import TEMPLATES, features_of, fit_licences, op4_license_scan, scan_licences, words_of

SF = "/root/testdata/sf0.01"


def _plain(rows, model, least_cover=0.7):
    """Every paragraph scored by the definition, without looking for cues first."""
    out = set()
    for doc_id, text in rows:
        for k, line in enumerate((text or "").split("\n") if text is not None else []):
            words = words_of(line)
            features = features_of(words)
            margin, family = max((model.bias[f] + sum(w.get(x, 0) for x in features), f) for f, w in model.weights.items())
            score = 1 / (1 + math.exp(-(model.curve[0] + model.curve[1] * margin)))
            if score >= model.least_score and features & set(model.weights[family]):
                cover = max(len(set(words_of(t)) & set(words)) / len(set(words_of(t))) for t in TEMPLATES[family])
                out.add((doc_id, k, family, round(score, 4), round(cover, 4), cover >= least_cover))
    return out


def _got(df):
    return {(r["doc_id"], r["paragraph"], r["family"], round(r["score"], 4), round(r["cover"], 4), r["confirmed"]) for r in df.collect()}


def test_against_scoring_of_every_paragraph(spark):
    docs = table(spark, SF, "documents")
    model = fit_licences(docs)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert _got(scan_licences(docs, model)) == _plain(rows, model)
    # and the notices that stand in the table are found and confirmed, nothing else is
    notices = {"Released under the MIT License.": "MIT", "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Licensed under CC BY-NC 4.0.": "CC-BY-NC",
               "This work is licensed under the GNU General Public License, version 3.": "GPL"}
    want = {(i, k, f) for i, t in rows for k, line in enumerate(t.split("\n")) for n, f in notices.items() if words_of(n) == words_of(line)}
    confirmed = {(r["doc_id"], r["paragraph"], r["family"]) for r in op4_license_scan(spark, SF).where("confirmed").collect()}
    assert len(want) > 10 and want <= confirmed and len(confirmed - want) <= 0.1 * len(want)


def test_families_and_odd_rows(documents):
    rows = [(i, t) for i, t in enumerate(x for ts in TEMPLATES.values() for x in ts)]
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, "the plain words of a line\nand one more"), (104, "clean " * 5000 + "\nReleased under the MIT License."), (105, "we went to the license office")]
    rows += [(500 + i, "some ordinary words number %d stand in this line" % i) for i in range(300)]
    docs = documents(rows + [(104, rows[-301][1])] + [(None, "Licensed under CC BY-NC 4.0.")], extra=True)
    model = fit_licences(docs)
    got = {(r["doc_id"], r["paragraph"]): r for r in scan_licences(docs, model).collect()}
    families = [f for f, ts in TEMPLATES.items() for _ in ts]
    right = sum((i, 0) in got and got[i, 0]["family"] == f and got[i, 0]["confirmed"] for i, f in enumerate(families))
    assert right >= 0.9 * len(families)
    assert got[104, 1]["family"] == "MIT" and got[None, 0]["family"] == "CC-BY-NC"
    assert not any(r["confirmed"] for (i, _), r in got.items() if i is not None and (100 <= i < 104 or i >= 105))


def test_empty(documents):
    docs = documents([])
    assert scan_licences(docs, fit_licences(docs)).count() == 0
