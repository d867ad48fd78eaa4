"""Line and substring dedup, fingerprints and quality rules against plain Python."""

import hashlib
import re
from collections import defaultdict

import pytest
import xxhash
from small import DOCS, WORD, documents, edge_tables, story

import corpus_pipeline
from tideline.llm import fingerprints, line_dedup, quality_rules, substring_dedup
from tideline.llm.common import QUERIES

FOLDER = "/root/testdata/sf0.001"


def lines_by_hand(docs, run=3):
    """Texts by doc_id after the deletion of later runs; docs: (doc_id, text) in order."""
    seen, out = set(), {}
    for i, text in docs:
        lines = text.split("\n")
        ink = [j for j, line in enumerate(lines) if WORD.search(line)]
        length = min(run, len(ink))
        gone = set()
        for a in range(len(ink) - length + 1 if ink else 0):
            window = tuple(lines[j] for j in ink[a:a + length])
            if window in seen:
                gone.update(ink[a:a + length])
            seen.add(window)
        out[i] = "\n".join(line for j, line in enumerate(lines) if j not in gone)
    return out


def test_line_dedup_by_hand(spark):
    a, b, c = "\n".join("abcde"), "\n".join("xbcdy"), "\n".join("pbcd")
    texts = [a, b, "", c, "a\n\nb\n \nc\nq", "l\nm", "l\nm", "k\nk\nk\nk\nk", "\n\n"]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(documents(spark, texts)).collect()}
    assert got == lines_by_hand(list(enumerate(texts)))
    assert got[1] == "x\ny" and got[6] == "" and got[7] == "k\nk"[:1]


@pytest.mark.parametrize("gram,window", [(1, 3), (2, 2), (3, 1)])
def test_winnowing_misses_no_run_of_the_guaranteed_length(spark, gram, window):
    texts = ["\n".join(str((i * k) % 7) for k in range(30)) for i in range(1, 12)]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(documents(spark, texts), gram=gram, window=window).collect()}
    assert got == lines_by_hand(list(enumerate(texts)))


def single_lines_by_hand(docs, alone, run=3):
    """As lines_by_hand, and later repeats of lines of ``alone`` words or more go too."""
    by_runs, seen, out = lines_by_hand_places(docs, run), set(), {}
    for i, text in docs:
        lines = text.split("\n")
        gone = set(by_runs[i])
        for j, line in enumerate(lines):
            if len(WORD.findall(line)) >= alone:
                if line in seen:
                    gone.add(j)
                seen.add(line)
        out[i] = "\n".join(line for j, line in enumerate(lines) if j not in gone)
    return out


def lines_by_hand_places(docs, run=3):
    seen, out = set(), {}
    for i, text in docs:
        lines = text.split("\n")
        ink = [j for j, line in enumerate(lines) if WORD.search(line)]
        length = min(run, len(ink))
        out[i] = set()
        for a in range(len(ink) - length + 1 if ink else 0):
            window = tuple(lines[j] for j in ink[a:a + length])
            if window in seen:
                out[i].update(ink[a:a + length])
            seen.add(window)
    return out


def test_long_lines_are_matched_alone(spark):
    ten, nine = " ".join("abcdefghij"), " ".join("abcdefghi")
    texts = [f"p\n{ten}\nq", f"r\n{ten}\ns\n{nine}", ten, f"t\n{nine}\nu\n\t{ten} ", f"{ten}\n{ten}", f"v\n \n\t{ten} ",
             "k\nl\nm", "k\nl\nm\nn", "", ten.replace("e", "漢")]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(documents(spark, texts), alone=10).collect()}
    assert got == single_lines_by_hand(list(enumerate(texts)), 10)
    assert got[1] == f"r\ns\n{nine}" and got[2] == got[4] == "" and got[3] == texts[3] and got[5] == "v\n "
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect() if r.text is not None)
    stage = dict(corpus_pipeline.STAGES)["line dedup"](spark, spark.read.parquet(f"{FOLDER}/documents.parquet"), FOLDER)
    assert {r.doc_id: r.text for r in stage.collect() if r.text is not None} == single_lines_by_hand(docs, 10)


def test_line_dedup_edges(spark):
    full, empty = edge_tables(spark)
    clash = full.selectExpr("*", "1 AS n_lines", "2 AS `odd name`")
    out = line_dedup.dedup_lines(clash, counts=True)
    assert out.count() == full.count() and sorted(out.columns) == sorted([*clash.columns, "n_deleted"])
    assert [r.text for r in out.where("doc_id IS NULL").orderBy("text").collect()] == [None, "null id"]
    assert line_dedup.dedup_lines(empty).count() == 0


def test_substring_dedup_cuts_passages_and_nothing_else(spark):
    passage = " ".join(story("p", 60).split())
    clean = [story(k) for k in range(20)]
    with_passage = [f"{story(100 + k, 40)}\n{passage} {story(200 + k, 40)}" for k in range(6)]
    got = {r.doc_id: r for r in substring_dedup.dedup_substrings(documents(spark, clean + with_passage), counts=True).collect()}
    assert all(got[k].text == t and got[k].n_cut_words == 0 for k, t in enumerate(clean))
    assert got[20].text == with_passage[0]
    for k in range(1, 6):
        assert 30 <= got[20 + k].n_cut_words <= 60, k
        assert got[20 + k].text.startswith(story(100 + k, 40).split()[0])
        # what is left are words of the text in their order
        left, words = got[20 + k].text.split(), iter(with_passage[k].split())
        assert all(w in words for w in left) and len(left) + got[20 + k].n_cut_words == len(with_passage[k].split())


def test_substring_chunks_resist_insertions(spark):
    base = " ".join(story(7, 300).split())
    words = base.split()
    moved = " ".join(words[:20] + ["inserted", "words"] + words[20:])
    got = {r.doc_id: r for r in substring_dedup.dedup_substrings(documents(spark, [base, moved]), counts=True).collect()}
    assert got[0].n_cut_words == 0 and got[1].n_cut_words > 240


def test_substring_query_against_brute_force(spark):
    rows = {r.doc_id: r for r in QUERIES["op2_substring_dedup"](spark, FOLDER).collect()}
    docs = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect())
    seen, eight, later, repeated = set(), set(), defaultdict(set), defaultdict(set)
    for i, text in docs:
        ws = text.split()
        for size, known, out in ((51, seen, later), (8, eight, repeated)):
            for a in range(len(ws) - size + 1):
                h = tuple(ws[a:a + size])
                if h in known:
                    out[i].update(range(a, a + size))
                known.add(h)
    assert set(rows) == {i for i, _ in docs}
    for i, text in docs:
        assert rows[i].n_cut_words <= len(repeated[i])  # nothing that isn't repeated
        assert len(rows[i].text.split()) + rows[i].n_cut_words == len(text.split())
        if not repeated[i]:
            assert rows[i].text == text
    found = [rows[i].n_cut_words >= 0.5 * len(x) for i, x in later.items()]
    assert len(found) > 20 and sum(found) >= 0.85 * len(found)


def test_substring_edges(spark):
    full, empty = edge_tables(spark)
    clash = full.selectExpr("*", "1 AS n_cut_words", "2 AS `odd name`")
    out = substring_dedup.dedup_substrings(clash, counts=True)
    assert out.count() == full.count() and sorted(out.columns) == sorted(clash.columns)
    assert out.where("text IS NULL").count() == full.where("text IS NULL").count()
    assert substring_dedup.dedup_substrings(empty).count() == 0


def test_fingerprints_against_plain_python(spark):
    rows = QUERIES["op3_document_fingerprints"](spark, FOLDER).collect()
    docs = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect())
    got = {r.doc_id: r for r in rows}
    by_text = {}
    for k, (i, t) in enumerate(docs):
        after = docs[(k + 1) % len(docs)][1]
        edited = t[:len(t) - len(t) // 4] + after[:len(t) // 4]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert by_text.setdefault(t, got[i].fingerprint) == got[i].fingerprint
        assert (got[i].near_edited == 1) == (edited == t) and 0 <= got[i].near_next <= 1
        assert (got[i].fingerprint == got[i].edited_fingerprint) == (edited == t)
    assert len(set(by_text.values())) == len(by_text)
    near = sorted(r.near_edited for r in rows)
    assert near[len(near) // 2] > 0.6 and sum(r.near_edited > r.near_next for r in rows) > 0.98 * len(rows)


def test_fingerprint_tree_locates_edits(spark):
    texts = ["one\ntwo\n\nthree\nfour", "one\ntwo\n\nthree\nFOUR", "one\ntwo\n\nthree\nfour"]
    tree = fingerprints.with_tree(documents(spark, texts), "text").select("doc_id", "fingerprint")
    a, b, c = (r.fingerprint for r in tree.orderBy("doc_id").collect())
    assert a == c and a[:64] != b[:64] and a.split("|")[0][64:] == b.split("|")[0][64:]
    pair = spark.createDataFrame([(a, b)], "a string, b string")
    assert [tuple(d) for d in pair.select(fingerprints.differing_paragraphs(pair.a, pair.b).alias("d")).first().d] == [(1, 1)]


def blocks_by_hand(text):
    """Digests of the blocks, by the rule in words."""
    found = set()
    for section in re.split(r"\n[\x20\x09-\x0D]*\n", text):
        for paragraph in section.split("\n"):
            pieces = re.findall(r"\S+\s*", paragraph, re.ASCII)
            block, at, count = [], 0, 0
            while at < len(pieces):
                block.append(pieces[at])
                count += 1
                word = pieces[at].rstrip(" \t\n\x0b\x0c\r")
                last = at == len(pieces) - 1
                if last or word[-1] in "entr.,!?" or count == 8:
                    found.add("".join(block))
                    block, count = [], 0
                at += 1
            if len(paragraph) < 240:
                found.update(pieces)
    return {xxhash.xxh64(b.encode(), seed=42).intdigest() & 0xFFFFFF for b in found}


def likeness_by_hand(a, b):
    if a == b:
        return 1.0
    x, y = blocks_by_hand(a), blocks_by_hand(b)
    total = len(x) + len(y)
    return min(2 * len(x & y) / total if total else 0.0, 1 - 1 / (total + 2))


def test_fingerprint_likeness_by_hand(spark):
    """near_edited and near_next of the whole result, by plain Python."""
    rows = {r.doc_id: r for r in QUERIES["op3_document_fingerprints"](spark, FOLDER).collect()}
    docs = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect())
    assert len(rows) == len(docs)
    for k, (i, t) in enumerate(docs):
        after = docs[(k + 1) % len(docs)][1]
        edited = t[:len(t) - len(t) // 4] + after[:len(t) // 4]
        assert rows[i].near_edited == pytest.approx(likeness_by_hand(t, edited), abs=1e-12), i
        assert rows[i].near_next == pytest.approx(likeness_by_hand(t, after), abs=1e-12), i


def test_fingerprint_of_small_edits(spark):
    words = story(5, 2000).split()
    line = " ".join(words)
    lines = ["one two three", "four five six", "seven eight nine"]
    texts = [line, "odd " + line, " ".join([*words[:900], "odd", *words[900:]]), "\n".join(lines), "\n".join([lines[1], lines[0], lines[2]]),
             "a\n\nb", "a\n\nb\n\nc"]
    trees = {r.doc_id: r for r in fingerprints.with_tree(documents(spark, texts), "text").collect()}
    pairs = spark.createDataFrame([(k, trees[a].fingerprint, trees[a].blocks, trees[b].fingerprint, trees[b].blocks)
                                   for k, (a, b) in enumerate([(0, 1), (0, 2), (3, 4), (5, 6), (6, 5), (0, 0)])], "k int, f string, b array<int>, g string, c array<int>")
    out = {r.k: r for r in pairs.select("k", fingerprints.likeness(pairs.f, pairs.b, pairs.g, pairs.c).alias("near"),
                                        fingerprints.differing_paragraphs(pairs.f, pairs.g).alias("d")).collect()}
    places = {k: [tuple(x) for x in r.d] for k, r in out.items()}
    assert 0.9 < out[0].near < 1 and 0.9 < out[1].near < 1 and places[0] == places[1] == [(0, 0)]
    assert 0.5 < out[2].near < 1 and places[2] == [(0, 0), (0, 1)]
    assert places[3] == [] and places[4] == [(2, 0)] and out[5].near == 1 and places[5] == []


def test_fingerprint_edges(spark):
    full, empty = edge_tables(spark)
    out = fingerprints.compare_with_edits(full).collect()
    assert len(out) == full.count()
    assert fingerprints.compare_with_edits(empty).count() == 0
    alone = fingerprints.compare_with_edits(documents(spark, ["abcd efgh"])).first()
    assert alone.edited_sha256 == hashlib.sha256(b"abcd efab").hexdigest() and alone.near_next == 1


def base_by_hand(text):
    words = WORD.findall(text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    count = defaultdict(int)
    for w in windows:
        count[w] += 1
    covered = {p for i, w in enumerate(windows) if count[w] > 1 for p in (i, i + 1, i + 2)}
    ink = [line for line in text.split("\n") if WORD.search(line)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(ink) - len(set(ink)), len(covered),
            len(words) < 50 or 100 * len(covered) > 50 * len(words))


def test_quality_base_by_hand_and_edges(spark):
    full, empty = edge_tables(spark)
    clash = full.selectExpr("*", "1 AS kept", "2 AS n_words")
    out = quality_rules.cascade(clash).collect()
    assert len(out) == full.count()
    for r in out:
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
        assert got == base_by_hand(r.text or ""), r.text
        assert not (r.kept and r.base_failed)
    assert {r.doc_id: r.kept for r in out}[20]  # plain prose stays
    assert quality_rules.cascade(empty).count() == 0


def test_rule_order_follows_rejections_and_changes_no_verdict(spark):
    docs = documents(spark, [story(k) for k in range(5)] + ["#$ " * 60])
    rules = quality_rules.default_rules()
    assert sorted(quality_rules.order_rules(quality_rules.base_columns(docs), rules)) == sorted(rules)
    one = {r.doc_id: r.kept for r in quality_rules.cascade(docs, sample_rows=1).collect()}
    assert one == {r.doc_id: r.kept for r in quality_rules.cascade(docs).collect()} and not one[5]


def test_schema_of_documents_is_the_tested_one(spark):
    assert spark.createDataFrame([], DOCS).dtypes == spark.read.parquet(f"{FOLDER}/documents.parquet").dtypes


#: Names of helper columns and outputs anywhere in the operators, in several cases.
CLASHES = ("_k1 _k2 _lines _gone _key _id _later _group sig node grams parity _row _full _short _at _part _rank _text _words "
           "_inked _windows _doc _hash _user token n_lines n_cut_words N_Shingles class_id component_id kept host Path rule verdict "
           "user_column_1 sequence_id offset length").split()


def with_clashes(df, but=()):
    from pyspark.sql import functions as F

    names = [c for c in CLASHES if c not in but]
    return df.select("*", *[F.lit(f"own {c}").alias(c) for c in names], F.lit("own dotted").alias("a.b `c`")), [*names, "a.b `c`"]


@pytest.mark.parametrize("name", ["lines", "substrings", "join", "one of each", "urls", "best fit", "rules"])
def test_further_columns_of_any_name(spark, name):
    """Helper names don't touch them; they come back as they were unless an output has their name."""
    from tideline.llm import line_dedup, ngram_join, packing, quality_rules, substring_dedup, url_filter

    full, _ = edge_tables(spark)
    if name == "urls":
        base = spark.createDataFrame([(i, f"https://a.org/{i}") for i in range(5)], "page_id long, url string")
        rules = spark.createDataFrame([("org", "/", "block", 1)], "host string, path string, verdict string, _full int")
        run = lambda d: url_filter.judge(d, rules)
    elif name == "best fit":
        base = spark.createDataFrame([(i, i % 7 + 1) for i in range(40)], "piece long, length long")
        run = lambda d: packing.best_fit(d, 10)
    else:
        base = full.select("doc_id", "text")
        run = {
            "lines": lambda d: line_dedup.dedup_lines(d, counts=True, alone=3),
            "substrings": lambda d: substring_dedup.dedup_substrings(d, counts=True),
            "join": lambda d: ngram_join.jaccard_join(d, n=2), "one of each": lambda d: ngram_join.one_of_each_group(d, n=2),
            "rules": quality_rules.cascade,
        }[name]
    plain = run(base)
    extended, names = with_clashes(base, base.columns)
    out = run(extended)
    made = [c for c in plain.columns if c not in base.columns]
    stay = [n for n in names if n.lower() not in [m.lower() for m in made]]
    assert sorted(out.columns) == sorted([*plain.columns, *stay])
    quoted = lambda c: "`" + c.replace("`", "``") + "`"
    rows = out.select(*[quoted(c) for c in stay]).distinct().collect()
    assert [tuple(r) for r in rows] == [tuple("own dotted" if n == "a.b `c`" else f"own {n}" for n in stay)]
    if name != "best fit":  # places within a length are free
        same = [quoted(c) for c in plain.columns]
        assert sorted(map(repr, out.select(*same).collect())) == sorted(map(repr, plain.select(*same).collect()))


def test_roles_may_have_other_names(spark):
    from tideline.llm import line_dedup, ngram_join

    docs = spark.createDataFrame([(1, "a b\nc d", "x"), (2, "a b\nc d", "y")], "_k1 long, _lines string, text string")
    got = {r["_k1"]: (r["_lines"], r["text"]) for r in line_dedup.dedup_lines(docs, "_k1", "_lines", alone=2).collect()}
    assert got == {1: ("a b\nc d", "x"), 2: ("", "y")}
    rows = ngram_join.jaccard_join(docs, "_k1", "_lines", n=2).collect()
    assert {(r["_k1"], r["text"], r["component_id"]) for r in rows} == {(1, "x", 1), (2, "y", 1)}


def test_rules_are_ordered_alike_in_every_call(spark):
    from tideline.llm import quality_rules
    from tideline.llm.common import checkpointed

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("text")
    sample = checkpointed(quality_rules.base_columns(docs, "text"))
    from pyspark.sql import functions as F

    rules = {"dear": F.length(F.regexp_replace("text", "([a-z]+)([^a-z]+)", "$2$1")) < -1, "none": F.col("n_words") < 0,
             "many": F.col("n_words") > 0, "half": F.col("n_words") % 2 == 0}
    orders = [quality_rules.order_rules(sample, rules) for _ in range(5)]
    assert all(o[0] == "many" and o[-1] == "dear" for o in orders), orders
