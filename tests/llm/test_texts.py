"""Problems 8, 9 and 10 against brute force and at their edges."""

import bisect
import random
import re
from collections import Counter
from re import _constants as sre
from re._parser import parse

import numpy as np
import pytest

from strandloom.llm import leakage, packing, residue, texts

DOCUMENT = "doc bigint, text string, path string, n_tokens int, kind string"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "p", -1, "k") for i, t in rows], DOCUMENT)


# --- 8 ---


def best_fit_decreasing(sizes, capacity):
    gaps, opened = [], 0
    for s in sorted(sizes, reverse=True):
        at = bisect.bisect_left(gaps, s)
        gap = gaps.pop(at) if at < len(gaps) else capacity
        opened += gap == capacity
        if gap > s:
            bisect.insort(gaps, gap - s)
    return opened


def test_sweep_equals_best_fit_within_a_range():
    rng = random.Random(3)
    for _ in range(100):
        sizes = np.array(sorted((rng.randint(20, 60) for _ in range(rng.randint(0, 60))), reverse=True), dtype=np.int64)
        gaps = np.array([rng.randint(1, 120) for _ in range(rng.randint(0, 40))], dtype=np.int64)
        target, left = packing.sweep(sizes, gaps, 20)
        open_, want = sorted(gaps.tolist()), []
        for s in sizes.tolist():
            at = bisect.bisect_left(open_, s)
            want.append(open_.pop(at) if at < len(open_) else None)
            if want[-1] is not None:
                bisect.insort(open_, want[-1] - s)
        assert (target >= 0).tolist() == [w is not None for w in want]
        assert sorted(left.tolist()) == open_


def test_runs_give_each_rank_one_gap():
    rng = random.Random(4)
    for _ in range(100):
        cells = [(n, s, rng.randint(0, 30), 100 - 10 * n, rng.randint(0, 12), 100 - 10 * n) for n in range(8) for s in range(rng.randint(1, 3))]
        room, seen = {(n, s): (g, least) for n, s, _, _, g, least in cells}, Counter()
        for number, salt, first, end, n, s, at, each in packing.runs(cells):
            greatest = next(c[3] for c in cells if c[:2] == (number, salt))
            assert n < number and each * greatest <= room[n, s][1] and first < end
            for rank in range(first, end):
                seen[n, s, at + (rank - first) // each] += 1
                assert seen[n, s, at + (rank - first) // each] <= each and at + (rank - first) // each < room[n, s][0]


def test_ranges_follow_the_counts():
    made = packing.ranges({100: 5, 90: 4, 50: 45, 20: 3, 10: 3}, 10)
    assert made == [(100, 0, 90, 1), (90, 0, 90, 1), (50, 1, 50, 5), (20, 2, 10, 1), (10, 2, 10, 1)]
    assert packing.ranges({}, 10) == []


def check_containers(got, n_rows, capacity):
    used = Counter()
    for r in got:
        if r["container"] is not None:
            used[r["container"]] += r["n_tokens"]
        assert (r["container"] is None) == (r["n_tokens"] == 0) and (r["n_pieces"] == 1 or r["n_tokens"] == capacity or r["piece"] == r["n_pieces"] - 1)
    assert max(used.values()) <= capacity
    assert sum(r["piece"] == 0 for r in got) == n_rows
    best = best_fit_decreasing([r["n_tokens"] for r in got if r["n_tokens"]], capacity)
    assert len(used) <= max(best + 1, 1.01 * best)


@pytest.mark.parametrize("wide", [20_000, 60])
def test_packing(spark, monkeypatch, wide):
    monkeypatch.setattr(packing, "_RANGE", wide)
    rows = [(1, None), (2, ""), (3, "word " * 5_000), (4, "a b c"), (5, "a b c"), (5, "d"), (None, "e f")] + [(10 + i, "tok " * (i % 40 + 1)) for i in range(300)]
    got = packing.pack(documents(spark, rows), "doc", "text", capacity=64).collect()
    check_containers(got, len(rows), 64)
    long = sorted((r["piece"], r["from_token"], r["n_tokens"]) for r in got if r["doc"] == 3)
    assert [p for p, _, _ in long] == list(range(len(long))) and all(f == 64 * p for p, f, _ in long) and all(n == 64 for _, _, n in long[:-1])
    assert [(r["container"], r["n_tokens"]) for r in got if r["doc"] in (1, 2)] == [(None, 0)] * 2
    assert packing.pack(documents(spark, rows).limit(0), "doc", "text").count() == 0


def test_large_ids_beside_a_null_stay_exact(spark):
    big = 2**62 + 1
    rows = [(big + i, "a b c") for i in range(5)] + [(None, "d e")]
    got = packing.pack(documents(spark, rows), "doc", "text").collect()
    assert {r["doc"] for r in got} == {None, *(big + i for i in range(5))}


def test_a_hot_size_is_salted(spark, monkeypatch):
    monkeypatch.setattr(packing, "_RANGE", 100)
    got = packing.pack(documents(spark, [(i, "same words here") for i in range(1_000)]), "doc", "text", capacity=30).collect()
    check_containers(got, 1_000, 30)


# --- 9 ---


def brute_distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(pattern):
        new = [i + 1]
        for j, b in enumerate(text):
            new.append(min(row[j] + (a != b), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_myers_equals_dynamic_programming():
    rng = random.Random(1)
    for _ in range(800):
        pattern = [rng.randint(1, 4) for _ in range(rng.randint(1, 80))]
        text = [rng.randint(0, 5) for _ in range(rng.randint(0, 90))]
        assert leakage.least_distance(pattern, text)[0] == brute_distance(pattern, text)


def test_forms_of_words():
    assert texts.words("The <b>ﬁrst</b> **x-y** &amp; T[C&gt;G]T, ３４") == ["the", "first", "xy", "tcgt", "34"]
    assert texts.words('{"p": "up\\nto \\u0041 \\"b\\""}') == ["p", "up", "to", "a", "b"]
    assert texts.words("> conti-\n> nuity so­ft ze​ro café %20 x%20y") == ["continuity", "soft", "zero", "cafe", "x", "y"]
    assert texts.words("") == [] and texts.words(" \n ** ") == []


WORDS = [f"w{i}" for i in range(400)]


def leaks(spark, docs, items):
    found = leakage.leaked(documents(spark, docs), "doc", "text", spark.createDataFrame(items, "item_id bigint, text string"), "item_id", "text")
    return {(r["item_id"], r["doc"]) for r in found.collect()}


def test_planted_passages(spark):
    rng = random.Random(7)
    items = [(i, " ".join(rng.choice(WORDS) for _ in range(60))) for i in range(20)] + [(90, None), (91, "too short to leak"), (92, "")]
    filler = lambda n: [rng.choice("the of and a b c d e f".split()) for _ in range(n)]
    docs, want = [(900, None), (901, ""), (902, "the"), (None, items[0][1])], set()
    for i, text in items[:20]:
        own = text.split()
        start = rng.randint(0, 36)
        passage = own[start : start + 24]
        for edits in range(6):
            changed = list(passage)
            for at in sorted(rng.sample(range(1, 23), edits), reverse=True):
                kind = rng.choice(("change", "lose", "add"))
                changed[at : at + (kind != "add")] = [] if kind == "lose" else ["zzz"]
            doc = 100 * i + edits
            docs.append((doc, " ".join(filler(15) + changed + filler(15)).upper()))
            if leakage.least_distance(passage, changed)[0] <= 3:
                want.add((i, doc))
        docs.append((100 * i + 50, " ".join(filler(5) + own[start : start + 18] + filler(5))))  # too short a quotation
        docs.append((100 * i + 60, "*" + "*, ".join(own) + "*"))
        want.add((i, 100 * i + 60))
    docs += [docs[-1]]
    got = leaks(spark, docs, items)
    assert want <= got
    for i, doc in got - want:  # what else is found lies within the definition on another stretch
        own, text = dict(items)[i].split(), dict(d for d in docs if d[0] is not None)[doc].lower().split()
        assert any(brute_distance(own[a : a + n], text) <= n // 8 for n in (24, 32, 40) for a in range(61 - n))
    assert not any(doc % 100 == 50 for _, doc in got)
    assert leaks(spark, [], items) == set() and leaks(spark, docs, []) == set()


def test_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(leakage, "BLOCK_WORDS", 40)
    items = [(i, " ".join(f"i{i}x{j}" for j in range(30))) for i in range(5)]
    assert leaks(spark, [(1, items[0][1] + " " + items[4][1]), (2, items[2][1])], items) == {(0, 1), (4, 1), (2, 2)}


def test_long_items_tags_and_links(spark):
    rng = random.Random(9)
    long = [f"w{rng.randint(0, 3_000)}" for _ in range(20_000)]
    item = [f"v{i}" for i in range(30)]
    tag = "<a href='" + "x" * 400 + "' title='y'>"
    docs = [
        (1, " ".join(long[7_000:7_030])), (2, "a b " + " ".join(long[100:106]) + " c d"), (3, " ".join(item[:12]) + f" {tag}" + " ".join(item[12:]) + "</a>"),
        (4, " ".join(item[:12]) + " [" + " ".join(item[12:20]) + "](http://" + "z" * 500 + ") " + " ".join(item[20:])),
        (5, " ".join(long)), (6, "%20".join(item)), (7, "x " * 30_000 + " ".join(item)),
    ]
    assert leaks(spark, docs, [(50, " ".join(long)), (51, " ".join(item))]) == {(50, 1), (50, 5), (51, 3), (51, 4), (51, 6), (51, 7)}


def test_every_passage_holds_one_of_the_lengths():
    """Any number of edits within one in eight, anywhere in a passage of 24 to 130 words."""
    rng = random.Random(2)
    for n in range(24, 131):
        for _ in range(6):
            edits = rng.choice((n // 8, n // 8, max(0, n // 8 - 1)))
            at = rng.sample(range(n), edits) if rng.random() < 0.7 else sorted({min(n - 1, i * n // max(1, edits) + rng.randint(0, 2)) for i in range(edits)})
            item = [f"i{k}" for k in range(n)]
            text = [f"{'c' if k in at else 'i'}{k}" for k in range(n)]
            index = leakage.Items([(1, " ".join(item))])
            assert index.leaks(" ".join(["a", "b", *text, "c"])), (n, at)


# --- 10 ---

CASES = [
    "This report covers {{ title }} and was prepared for the team.", "Dear [INSERT NAME HERE], the results are attached.", "Contact ________ for the raw files.", "The run ${RUN_ID} ended.",
    "404 Not Found", "<html><head><title>502 Bad Gateway</title></head><body><h1>Bad Gateway</h1></body></html>", "Access denied.", "Your session has expired. Sign in again to continue.",
    "Please enable JavaScript to view this report.", "Bitte aktivieren Sie JavaScript, um diese Seite anzuzeigen.", "Lo sentimos, la página solicitada no existe.", "Sayfa bulunamadı.",
    "Lorum ipsam dolar situm amera consec adipan elitus.", "TBD TBD TBD", "Your content here.", "TODO: write the summary before sending this out.", "Texto de ejemplo, sustituir antes de publicar.",
    "A good result was seen in all runs. Something went wrong on our side (code 5f39).", "Title\n\n[object Object] and more", "This section has not been written yet.", "test test test test test", "Report viewer\n\nText text text text", "[archived] 429 Too Many Requests", "Fwd: Access denied",
]
OTHERS = [
    None, "", "  \n ", "Readers saw '502 Bad Gateway' for an hour; the limit was raised.", "The mark {{ cluster }} in the page template stands for the library.", "A linter now rejects a page when [INSERT DATE HERE] is still in it.",
    "for f in $(ls shards); do echo \"${f}\"; done was replaced by a manifest.", "def name(i): return f'part-{i:05d}'  # used by the exporter", "The message 'session expired' means that the token is old.",
    "The interactive map is drawn with JavaScript, and the points are exported too.", "We removed the old TODO list because all entries were done.", "The channel T[C>G]T lost 404 of 500 loci.", "##INFO=<ID=DP,Number=1,Type=Integer>",
    "The banner `Please enable JavaScript` is gone.", "The launcher reads ${OUT_DIR} from the job file.", "A normal sentence about errors of the mean.",
]


def test_cases_and_mentions(spark):
    rows = list(enumerate([*CASES, *OTHERS])) + [(0, CASES[0]), (None, CASES[4]), (500, "An ordinary line. " * 20_000 + CASES[9])]
    got = residue.residue(documents(spark, rows), "doc", "text").collect()
    assert {r["doc"] for r in got} == {*range(len(CASES)), 500}
    assert len(got) == len({(r["doc"], r["verdict"]) for r in got})
    assert residue.residue(documents(spark, []), "doc", "text").count() == 0


@pytest.mark.parametrize("text", CASES)
def test_same_verdict_in_longer_texts(text):
    whole = "The first result stands.\n" + text + "\nThe second one does too."
    assert any(residue.has_slot(s) or residue.classify(s) for s in residue.segments(residue.prepared(whole)))


def test_tree_merges_and_keeps_apart():
    tree = residue.Tree()
    for n in (1, 2, 3):
        tree.add(f"run x{n} ended well after <n> epochs".split())
    tree.add("run x1 ended badly".split())
    merged = sorted(" ".join(t[0]) for leaf in tree.leaves.values() for t in leaf)
    assert merged == ["run <*> ended well after <n> epochs", "run x1 ended badly"]


def test_leaf_of_many_templates(monkeypatch):
    monkeypatch.setattr(residue, "COMPARED", 4)
    rng = random.Random(1)
    tree = residue.Tree()
    for _ in range(200):
        tree.add([*"the same six words go first".split(), *(f"w{rng.randint(0, 10**9)}" for _ in range(12))])
    assert sum(t[1] for leaf in tree.leaves.values() for t in leaf) == 200


def test_every_template_of_a_large_leaf_is_compared():
    """A wording joins the template that it agrees with, however many came before."""
    rng = random.Random(1)
    tree, words = residue.Tree(), lambda n: [f"w{rng.randint(0, 10**9)}" for _ in range(n)]
    firsts = [[*"the same six words go first".split(), *words(12)] for _ in range(2 * residue.COMPARED)]
    for last in ("one", "two", "three"):
        for first in firsts:
            tree.add([*first[:-1], last])
    (leaf,) = tree.leaves.values()
    assert [t[1] for t in leaf] == [3] * len(firsts) and all(t[0][-1] == residue.WILD for t in leaf)


def test_index_of_a_leaf_equals_a_scan(monkeypatch):
    for seed in range(60):
        rng, trees = random.Random(seed), []
        length, kinds = rng.randint(1, 20), rng.choice([2, 5, 30])
        shape = [rng.choice(("same", "word", f"n{i}-")) for i in range(length)]
        rows = [[residue.WILD if rng.random() < 0.03 else s if s == "same" or i < 4 and s == "word" else f"{s}{rng.randint(0, kinds)}" for i, s in enumerate(shape)] for _ in range(150)]
        for compared in (10**9, rng.randint(0, 20)):
            monkeypatch.setattr(residue, "COMPARED", compared)
            trees.append(residue.Tree())
            for n, row in enumerate(rows):
                trees[-1].add(row, n, 1)
        assert trees[0].leaves == trees[1].leaves, seed


def test_a_message_recurs_in_a_large_leaf(spark):
    """Three wordings of a notice are one template after hundreds of others with the same first words."""
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("bcdfghklmnprstv", k=9))
    many = [" ".join(word() for _ in range(5)) for _ in range(residue.COMPARED + 50)]
    few = [f"zulu yankee whisky victor {day}" for day in ("Friday", "Monday", "Tuesday")]
    rows = [(i, f"The first result stands.\nThe description of these loci in {t} is pending.\nThe next one follows.") for i, t in enumerate([*many, *few])]
    assert {r["doc"] for r in residue.residue(documents(spark, rows), "doc", "text").collect()} == set(range(len(many), len(rows)))
    got = residue.templates(residue.mined(documents(spark, rows), "doc", "text", everything=True)).where("verdict = 'filler'").collect()
    assert [r["merged"] for r in got] == ["The description of these loci in zulu yankee whisky victor <*> is pending."] * 3


def test_templates_of_everything(spark):
    rows = [(i, f"Error {i}: disk {i} failed. Access denied.") for i in range(30)]
    found = {}
    for r in residue.templates(residue.mined(documents(spark, rows), "doc", "text", everything=True)).collect():
        found[r["merged"]] = (r["verdict"], found.get(r["merged"], ("", 0))[1] + r["n"])
    assert found["Access denied."] == ("error", 30)
    assert any(m.startswith("Error <n>: disk <n> failed") and not v for m, (v, _) in found.items())


#: Messages in no list of the module.
HELD_OUT = [
    "Your request was blocked by our security policy.", "No content has been added to this section.", "Cookies and JavaScript need to be switched on.", "Strona nie została znaleziona", "<PLACEHOLDER>",
    "Description pending.", "The link you followed may be broken or the page may have been removed.", "We can't connect to the server right now.", "Sorry, this file is unavailable at the moment.",
    "Your login has expired, please sign in once more.", "The summary will be published later.", "Abstract to be supplied.", "Your browser blocks scripts that this page requires.",
    "To see the plots, allow scripts in your browser.", "This site needs cookies to be enabled.", "Die Datei ist derzeit nicht verfügbar.", "Der Inhalt dieses Abschnitts folgt in Kürze.",
    "Der Zugang wurde gesperrt.", "El archivo no está disponible.", "El contenido de esta sección está pendiente.", "La sesión ha caducado.", "Le contenu de cette rubrique est à venir.", "Le fichier est introuvable.",
    "Le service est momentanément indisponible.", "La sezione è da completare.", "La richiesta è stata bloccata.", "O serviço está indisponível.", "A descrição desta seção está em construção.", "De inhoud volgt binnenkort.",
    "Deze sectie is nog niet beschikbaar.", "Bu bölüm henüz hazır değil.", "Dosya bulunamadı.", "Treść tej sekcji pojawi się wkrótce.", "Доступ запрещён.", "Раздел скоро появится.", "Sidan hittades inte.",
    "Przeglądarka wymaga włączenia JavaScript.", "Ce site requiert l'activation des cookies.", "This chapter is intentionally left blank.", "The connection to the gateway was reset or refused.",
]
#: Ordinary sentences of the domain that use the same words.
ORDINARY = [
    "The sections of the report follow the order of the runs, and every table is described where it first appears.", "Reads that were not found in the second delivery were dropped from the comparison of both batches.",
    "Variants without support are removed before the clusters are drawn, and the remaining loci keep their labels.", "The script writes one file per sample and the manifest lists all of them with their sizes.",
    "A cluster is empty when no locus of the run falls into it.", "The file holds 500 loci.", "The service level of the cluster was raised after the sweep ended.", "We describe the content of each column in the appendix of the report.",
    "The message 'access blocked' means that the token of the job is older than 12 hours.", "Loci with missing depth were left out of the summary statistics for the second and the third delivery of the week.",
    "The session on clustering discussed the failed runs of last month in detail.", "Each view shows the points of one run.", "The table below lists the number of rows per sample.", "Median quality was 41 in all batches.",
]


def test_messages_in_no_list(spark):
    rows = [*enumerate(HELD_OUT), *((100 + i, f"Results of run {i}\n\n{m}\n") for i, m in enumerate(HELD_OUT)), *((200 + i, m) for i, m in enumerate(ORDINARY))]
    found = {r["doc"] for r in residue.residue(documents(spark, rows), "doc", "text").collect()}
    assert not any(residue.classify(m) for m in HELD_OUT[:4]) and not {d for d in found if d >= 200}
    missed = [m for i, m in enumerate(HELD_OUT) if i not in found] + [m for i, m in enumerate(HELD_OUT) if 100 + i not in found]
    assert len(missed) <= 0.1 * 2 * len(HELD_OUT), missed


def test_a_message_is_known_by_its_template(spark):
    """Within ordinary text a short notice counts where its template recurs in the corpus."""
    line = lambda i: f"All loci were drawn again for the plot. The description of batch {i} is pending. The next run follows the plan."
    found = lambda n: residue.residue(documents(spark, [(i, line(i)) for i in range(n)]), "doc", "text").count()
    assert found(residue.RECURS - 1) == 0 and found(residue.RECURS) == residue.RECURS


def test_verdicts_do_not_depend_on_the_partitioning(spark):
    rows = [(i, f"The first result of run {i} stands. {m}") for i, m in enumerate(HELD_OUT * 4)]
    df = documents(spark, rows)
    got = [sorted(map(tuple, residue.residue(df.repartition(n), "doc", "text").collect())) for n in (1, 9)]
    assert got[0] == got[1] and got[0]


def match_of(parsed, rng):
    """A text that the parsed pattern matches, without what only looks around."""
    out = ""
    for op, arg in parsed:
        if op is sre.LITERAL:
            out += chr(arg)
        elif op is sre.SUBPATTERN:
            out += match_of(arg[-1], rng)
        elif op is sre.BRANCH:
            out += match_of(rng.choice(arg[1]), rng)
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            out += "".join(match_of(arg[2], rng) for _ in range(rng.randint(arg[0], max(arg[0], min(arg[1], 1)))))
        elif op is sre.IN:
            kind, one = rng.choice(arg)
            out += chr(one) if kind is sre.LITERAL else chr(one[0]) if kind is sre.RANGE else {sre.CATEGORY_DIGIT: "4", sre.CATEGORY_WORD: "a"}.get(one, " ")
        elif op is not sre.AT:
            out += " "
    return out


@pytest.mark.parametrize("pattern", sorted({p for _, _, p in residue.MESSAGES}))
def test_every_alternative_holds_a_cue(pattern):
    rng, parsed, tried = random.Random(1), parse(pattern), 0
    held = [residue.folded(cue) for cue, _, p in residue.MESSAGES if p == pattern]
    for _ in range(1_000):
        text = match_of(parsed, rng)
        for m in filter(None, (re.search(pattern, t, re.I) for t in (text, text.upper()))):
            tried += 1
            assert any(cue in residue.folded(m[0]) for cue in held), m[0]
    assert tried > 100


@pytest.mark.parametrize("text", [
    "503 Service Temporarily Unavailable", "504 Gateway Time-out", "Try again later.", "Texto de relleno", "Texto de muestra", "Dies ist ein Blindtext.", "Seu texto aqui", "Voorbeeldtekst",
    "Bitte später noch mal versuchen", "SAYFA BULUNAMADI", "Connection refused", "You are not authorised to see this.", "An error has occurred.", "The page could not be found",
])
def test_messages_of_every_alternative(text):
    assert residue.cues(residue.folded(text)) and residue.classify(text)


def test_telling_word_that_varies(spark):
    texts = [f"To open this interactive variant viewer, please {verb} JavaScript first." for verb in ("enable", "install", "compile")]
    rows = [(i, texts[i]) for i in (0, 1, 2)] + [(3, texts[1])]
    for parts in (1, 4):
        split = documents(spark, rows).repartition(parts)
        assert {r["doc"] for r in residue.residue(split, "doc", "text").collect()} == {0}
    alike = [(i, f"Where the whole study stands today: TBD {w}") for i, w in enumerate(("soonish", "", "."))]
    assert {r["doc"] for r in residue.residue(documents(spark, alike), "doc", "text").collect()} == {1, 2}


@pytest.mark.parametrize("text", [
    "The variant was called in {{sample_name}} and confirmed.", "The pattern of reads in {{sample_name}} was confirmed.", "Runs import their limits, and the sample is ${SAMPLE_ID} here.",
    "We return the samples of [INSERT NAME HERE] next week.", "The launcher failed, and the run ${RUN_ID} ended.",
])
def test_slot_behind_a_word_about_something_else(text):
    assert residue.has_slot(text)


@pytest.mark.parametrize("text", [
    "The token {{ name }} stays as it is.", "A variable named ${OUT_DIR} was set.", "The variables ${OUT_DIR}, ${SEED} and ${RUN_ID} are set first.", "Marks such as {{ x }} or {{ y }} are kept.",
    "The launcher reads ${OUT_DIR} and ${SEED} before the sweep.", "We renamed the field, so the template uses [object Object] now.",
])
def test_word_that_refers_to_the_mark(text):
    assert not residue.has_slot(text)
