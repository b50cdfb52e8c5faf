"""Extractive summary (C5) against a brute-force version, and the opt-in filter."""

import re

from conftest import dice
from gacetilla.operators.optin import opt_in
from gacetilla.operators.summary import SENTENCE_PATTERN, summarize
from gacetilla.sources.lexicon import BUILTIN_ROOTS, builtin_lexicon


def _brute(text, budget):
    roots = set(BUILTIN_ROOTS)
    sents = [(i + 1, s.strip(" ")) for i, s in enumerate(re.findall(SENTENCE_PATTERN, text))]
    sents = [(p, s) for p, s in sents if s]
    scored = []
    for p, s in sents:
        words = s.split()
        hits = sum(1 for w in words if any(dice(w, r) >= 0.75 for r in roots))
        scored.append((-hits, p, s, len(words)))
    scored.sort()
    kept, run = [], 0
    for rank, (_, p, s, n) in enumerate(scored, 1):
        run += n
        if rank == 1 or run <= budget:
            kept.append((p, s))
    return " ".join(s for _, s in sorted(kept))


def test_summary_matches_brute_force(spark):
    texts = [
        "The crisis deepens. Nothing here at all!\nThe President and the Government meet. Small talk?",
        "One. Two words. Climate policy and energy security are debated today by the minister.",
        "No punctuation at all just words and war",
    ]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.summary for r in summarize(docs, builtin_lexicon(spark), budget=8).collect()}
    for i, t in enumerate(texts):
        assert got[i] == _brute(t, 8)


def test_memory_of_a_summary_task_stays(spark, monkeypatch):
    """Tasks are added as the sentences grow, and no task sorts their texts."""
    import gacetilla.operators.summary as summary
    texts = [" ".join(f"Word{i}x{j} of the crisis and war number {j}." for j in range(40)) for i in range(12)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    want = {i: _brute(t, 30) for i, t in enumerate(texts)}
    monkeypatch.setattr(summary, "TASK_SENTENCES", 20, raising=False)
    found = summarize(docs, builtin_lexicon(spark), budget=30)
    plan = found._jdf.queryExecution().executedPlan().toString().split("\n")
    assert {r.doc_id: r.summary for r in found.collect()} == want
    # the texts stream past the kept positions; 480 sentences are dealt to 24 tasks
    assert sum("ShuffledHashJoin" in x for x in plan) == 1 and not [x for x in plan if "Sort [" in x and "sentence" in x]
    assert sum("Exchange hashpartitioning(doc_id" in x and "24)" in x for x in plan) >= 3


def test_summary_of_keys_that_repeat_or_are_null(spark):
    docs = spark.createDataFrame([(1, "War now. Calm day."), (1, "Calm sea. Crisis."), (None, "War.")], "doc_id long, text string")
    rows = summarize(docs, builtin_lexicon(spark), budget=30).collect()
    # each sentence meets each kept one of its place
    assert [(r.doc_id, r.n_sentences, r.n_tokens) for r in rows] == [(1, 8, 14)]


def test_opt_in_semantics(spark):
    items = spark.createDataFrame(
        [(1, "politics,economy", None), (2, None, "climate, war"), (3, "sports", "football"), (4, None, None)],
        "item_id long, categories string, keywords string")
    ids = lambda df: sorted(r.item_id for r in df.collect())
    assert ids(opt_in(items, ["econ", "war"], "or")) == [1, 2]
    assert ids(opt_in(items, ["econ", "war"], "and")) == []
    assert ids(opt_in(items, ["s,e"], "or")) == [1]            # across the comma
    assert ids(opt_in(items, [], "and")) == [1, 2, 3, 4]
    assert ids(opt_in(items, ["Econ"], "or")) == []            # no case change here
