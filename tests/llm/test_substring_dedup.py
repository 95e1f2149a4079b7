"""Substring deduplication against brute force and planted passages."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from provisio.llm import substring_dedup as X


def cut_units(text):
    """(start, stop, words) of all units, in the way that one would write down the rule."""
    at = 0
    for m in [*X.ENDS["sentence"].finditer(text), None]:
        stop = m.start() if m else len(text)
        words = [(at + w.start(), at + w.end()) for w in re.finditer(r"\S+", text[at:stop])]
        said = text[at:stop].lower().split()
        first = 0
        for end in X.pieces(said):
            if len(said) <= X.PIECE:
                yield at, stop, said
            else:
                yield words[first][0], words[end - 1][1] if end < len(said) else stop, said[first:end]
            first = end
        at = m.end() if m else stop


def brute(docs, least=X.LEAST_WORDS, anchor=X.ANCHOR):
    """{doc_id: places of removed units} and the units, for documents with distinct ids, by comparing the units themselves."""
    first, us, out = {}, {}, {}
    key = {}
    for d, t in sorted(docs):
        us[d] = list(cut_units(t or ""))
        for k, u in enumerate(us[d]):
            nth = key[d, k - 1][1] + 1 if k and us[d][k - 1][2] == u[2] else 0
            key[d, k] = (tuple(u[2]), nth)
            first.setdefault(key[d, k], (d, k))
    for d in us:
        groups, spans = {}, []
        for k in range(len(us[d])):
            if len(us[d][k][2]) < min(anchor, least):
                continue
            if (place := first[key[d, k]]) != (d, k):
                groups.setdefault((place[0], k - place[1]), set()).add(k)
            if key[d, k][1]:
                groups.setdefault((d, 1), set()).add(k)
        count = lambda a, b: sum(len(us[d][x][2]) for x in range(a, b))  # noqa: B023, E731
        for (o, shift), ks in groups.items():
            ks = sorted(ks)
            run = ks[:1]
            for k in [*ks[1:], None]:
                if k is not None and all(us[d][x][2] == us[o][x - shift][2] for x in range(run[-1], k)):
                    run.append(k)
                    continue
                if count(run[0], run[-1] + 1) >= min(least, X.PIECE):
                    spans.append((run[0], run[-1] + 1))
                run = [k]
        done, chains = 0, []
        for a, b in sorted(spans, key=lambda x: (x[0], -x[1])):
            if b > done:
                a = max(a, done)
                if chains and count(chains[-1][-1][1], a) <= X.PIECE:
                    chains[-1].append((a, b))
                else:
                    chains.append([(a, b)])
                done = b
        out[d] = [k for c in chains if sum(count(a, b) for a, b in c) >= least for a, b in c for k in range(a, b)]
    return out, us


def words_of(us, ks):
    return [w for k in ks for w in us[k][2]]


def test_whole_table(spark, sf_dir):
    """The removed units are those of brute force, and every span stands as a whole in the document that it names."""
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    want, us = brute(docs)
    plain = {d: " " + " ".join((t or "").lower().split()) + " " for d, t in docs}
    spans = 0
    for r in X.op1_substring_dedup(spark, sf_dir).collect():
        inside = sorted(k for s in r.spans for k, (a, b, _) in enumerate(us[r.doc_id]) if s.start <= a and b <= s.stop)
        assert inside == want[r.doc_id] and r.removed_words == len(words_of(us[r.doc_id], inside))
        for s in r.spans:
            spans += 1
            said = [w for a, b, ws in us[r.doc_id] if s.start <= a and b <= s.stop for w in ws]
            assert f" {' '.join(said)} " in plain[s.first_id] and s.first_id <= r.doc_id
    assert spans > 20


def test_units_cover_the_words_in_place():
    text = "One two. Three\n four five! " + " ".join(f"w{i}" for i in range(200)) + "\n\nend"
    cut = list(cut_units(text))
    assert [w for _, _, ws in cut for w in ws] == text.lower().split()
    assert [ws for _, _, ws in cut] == list(X.cut_words(text, X.ENDS["sentence"]))
    for a, b, ws in cut:
        assert text[a:b].lower().split() == ws


def test_planted_passages(spark):
    """A passage of 60 words is cut out of the later documents, at a line's end, inside a line and without full stops."""
    told = ". ".join(" ".join(f"p{i}q{k}" for k in range(6)) for i in range(10)) + "."
    flat = " ".join(f"z{i}" for i in range(90))
    own = lambda n: " ".join(f"own{n}x{k}" for k in range(30)) + "."
    docs = [(1, f"{own(1)}\n{told}\n{own(11)}"), (2, f"{own(2)} {told} {own(12)}"), (3, f"{own(3)}\n{told}"), (4, f"{own(4)} {flat} {own(14)}"), (5, f"{own(5)} {flat} {own(15)}"), (6, own(6))]
    df = spark.createDataFrame([(d, t, 0) for d, t in docs], "doc_id long, text string, spans int")
    cut = {r.doc_id: r.text for r in X.deduplicate(df).collect()}
    assert X.deduplicate(df).columns == df.columns
    for d in (1, 4, 6):
        assert cut[d] == dict(docs)[d]
    for d in (2, 3):
        assert told not in cut[d] and own(d) in cut[d] and "p5q3" not in cut[d]
    assert own(12) in cut[2]
    left = [w for w in cut[5].split() if re.fullmatch(r"z\d+", w)]
    assert len(left) < 40 and "own5x3" in cut[5] and "own15x29." in cut[5]


def test_edge_cases(spark):
    same = "the same words are here again and again. " * 10
    rows = [(1, None), (2, ""), (3, " \n "), (4, same), (None, same), (5, "w " * 120_000), (5, "w " * 120_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = X.removals(docs).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: r.removed_words for r in got}[None] == 80
    assert [r.removed_words for r in got if r.doc_id in (1, 2, 3)] == [0, 0, 0]
    assert X.removals(docs.limit(0)).count() == 0
    assert X.deduplicate(docs).filter(F.col("doc_id") == 1).first().text is None


def test_short_passages_at_random_places():
    """A passage of 51 words, in the middle of sentences, keeps all but PIECE words at each edge in repeated units; without short units, less."""
    rng = random.Random(51)
    own = lambda d: [f"own{d}x{k}" + "." * (rng.random() < 0.08) for k in range(80)]
    for end in (0.0, 0.08):
        for trial in range(200):
            told = [f"p{trial}q{k}" + "." * (rng.random() < end) for k in range(51)]
            docs = []
            for d in (1, 2):
                words, at = own(d), rng.randrange(80)
                docs.append((d, " ".join(words[:at] + told + words[at:])))
            gone, us = brute(docs, anchor=1)
            cut = words_of(us[2], gone[2])
            assert set(cut) <= set(told) and len(cut) >= 51 - 2 * X.PIECE, (trial, len(cut))
            usual = words_of(us[2], brute(docs)[0][2])
            assert set(usual) <= set(cut) and len(usual) >= 20, (trial, len(usual))


def test_no_piece_is_long():
    text = " ".join(f"w{i % 7}" for i in range(300))
    assert max(len(w) for _, _, w in cut_units(text)) <= X.PIECE


def test_clashing_names_and_whole_lines(spark):
    """With one word as the least, every line that occurs before goes, however short; clashing names do no harm."""
    long = " ".join(f"long{i}" for i in range(30))
    docs = spark.createDataFrame([(1, "One line.\nmine alone\nOne line.", 5, 6), (2, "one  LINE.\n" + long + "\nother", 5, 6), (3, "own\n" + long, 5, 6)], "doc_id long, text string, __id int, __spans int")
    cut = X.deduplicate(docs, "line", 1)
    assert cut.columns == docs.columns
    assert {r.doc_id: r.text.split("\n") for r in cut.collect()} == {1: ["One line.", "mine alone", ""], 2: ["", long, "other"], 3: ["own", ""]}


def test_pieces_of_several_sources_are_no_passage(spark):
    """Short sentences that each occur somewhere, but never together, stay; a passage together with them goes with its own origin."""
    short = [f"short sentence number {i} of many." for i in range(8)]
    told = " ".join(f"t{i}" for i in range(60))
    docs = [(i, f"own{i} a{i} b{i} c{i}. {s} end{i} of it all.") for i, s in enumerate(short)] + [(20, told), (30, " ".join(short)), (31, " ".join(short[:4]) + " " + told), (32, "x. " + " ".join(short[:4]))]
    found = {r.doc_id: r.spans for r in X.removals(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert found[30] == [] and {s.first_id for s in found[31]} == {20} and found[32] == []
