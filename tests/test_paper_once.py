"""Texts are gone through once for the issues of papers, not again to tell which issues stand for others."""

from provlake.operators import paper
from provlake.plans import papers

DATA = "/root/testdata/sf0.001"


def test_issues_are_made_once(spark, monkeypatch):
    seen, real = [], paper.checkpointed

    def checkpointed(df):
        seen.append(df._jdf.queryExecution().optimizedPlan().toString())
        return real(df)

    monkeypatch.setattr(paper, "checkpointed", checkpointed)
    papers.paper_issues(spark, DATA)
    reads = [p.count("parquet") for p in seen]
    assert reads[-1] == 0 < max(reads)
