"""Evidence queries against whole passages: what a cut of scores, tokens, sentences or cells would lose."""

import math
import re
from collections import Counter

from ledgerlight.functions.text import STOP_WORDS
from ledgerlight.plans import registry


def write(spark, folder, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def tokens(text):
    found = (re.sub("^-|-$", "", t) for t in re.findall(r"[^\W_](?:[^\W_]|-)+", text.lower()))
    return [t for t in found if len(t) >= 3 and t not in STOP_WORDS]


def brute_packets(lines, passage, most=8, blocks=16, budget=6000, least=0.75):
    """[(ordinal, role, score)] of one document's lines for a title, by the reference's rules."""
    toks = [tokens(x) for x in lines]
    mean, weight, df = sum(map(len, toks)) / len(toks), Counter(tokens(passage)), Counter(t for x in toks for t in set(x))
    found = []
    for i, x in enumerate(toks):
        tf = Counter(x)
        s = sum(4 * w * math.log(1 + (len(lines) - df[t] + 0.5) / (df[t] + 0.5)) * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(x) / max(1, mean))) for t, w in weight.items() if tf[t])
        if tf.keys() & weight.keys():
            s += 3 * (len(passage) >= 12 and passage.lower() in lines[i].lower())
            if s >= least:
                found.append((-round(s, 9), i))
    chosen = {}
    for s, i in sorted(found)[:most]:
        chosen[i] = (s, i, "match")
        for j, role in ((i - 1, "context_before"), (i + 1, "context_after")):
            if 0 <= j < len(lines):
                chosen.setdefault(j, (s * 0.2, j, role))
    out, total = [], 0
    for s, i, role in sorted(chosen.values()):
        if len(out) < blocks and total + len(toks[i]) <= budget:
            total += len(toks[i])
            out.append((i + 1, role, round(-s, 6)))
    return out


def test_packets_hold_partial_matches_and_long_blocks(spark, tmp_path):
    long = "quarterly audit committee " + " ".join(f"filler{i}" for i in range(200))
    lines = ["Opening words.", "The audit was short.", "Nothing here.", "Unrelated again.", "More unrelated.", long, "Closing words.", "End."]
    passage = "quarterly audit committee"
    sf = write(spark, tmp_path, documents=([(1, "\n".join(lines))], "doc_id long, text string"), benchmark=([(7, passage)], "item_id long, text string"))
    got = registry.QUERIES["d1_evidence_packets"](spark, sf).orderBy("rank").collect()
    assert [(r.ordinal, r.role, round(r.score, 6)) for r in got] == brute_packets(lines, passage)
    assert any(r.n_tokens > 120 for r in got) and any(r.role == "match" and r.score < 40 for r in got)
    assert registry.FLAGSHIP == "d1_evidence_packets"


def test_quotes_of_every_sentence(spark, tmp_path):
    passage = "Short. The second sentence of this passage speaks of collateral agreements.\n東京都の監査報告書. One (two). End ,"
    docs = [(1, "short of it\nnone"), (2, "He said: the second sentence of this passage speaks of collateral agreements."), (3, "前文東京都の監査報告書後文"), (4, "one (two)"), (5, "endless")]
    sf = write(spark, tmp_path, documents=(docs, "doc_id long, text string"), benchmark=([(7, passage)], "item_id long, text string"))
    got = {(r.doc_id, r.ordinal, r.sentence, r.grounded) for r in registry.QUERIES["p8_all_quotes"](spark, sf).collect()}
    assert got == {
        (1, 1, 1, "short"), (2, 1, 2, "the second sentence of this passage speaks of collateral agreements"),
        (3, 1, 3, "東京都の監査報告書"), (4, 1, 4, "one (two)"), (5, 1, 5, "end"),
    }


def test_export_holds_whole_passages(spark, tmp_path):
    long, full = "x" * 40_000, "=" + "y" * 32_766
    rows = [(1, 0, "user", "a" * 50), (1, 1, "user", "b" * 50), (2, 0, "user", long), (3, 0, "user", full)]
    sf = write(spark, tmp_path, conversations=(rows, "conv_id long, turn int, role string, text string"))
    got = {r.conv_id: r for r in registry.QUERIES["s10_whole_passages"](spark, sf).collect()}
    assert got[1].passages == "• " + "a" * 50 + "\n• " + "b" * 50
    assert got[2].passages == ("• " + long)[:32_753] + " … [gekürzt]" and got[2].safe == long[:32_753] + " … [gekürzt]"
    assert got[3].safe == ("'" + full)[:32_753] + " … [gekürzt]"


def test_documents_of_one_piece_are_dealt_over_tasks_for_quotes(spark, tmp_path):
    docs = [(k, "Eine Zeile vom Bericht\nund, (noch) eine - Zeile") for k in range(12)]
    sf = write(spark, tmp_path, documents=(docs, "doc_id long, text string"), benchmark=([(7, "Zeile vom Bericht. Und, (noch) eine - Zeile")], "item_id long, text string"))
    df = registry.QUERIES["p8_all_quotes"](spark, sf)
    assert "hashpartitioning(doc_id" in df._jdf.queryExecution().executedPlan().toString()
    got = {(r.doc_id, r.ordinal, r.sentence, r.grounded) for r in df.collect()}
    assert got == {(k, *x) for k in range(12) for x in ((1, 1, "Zeile vom Bericht"), (2, 2, "und, (noch) eine - Zeile"))}
