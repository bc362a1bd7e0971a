import json
import random
import time

import numpy as np
import pytest

from graphloom.llm import leakage, provenance, reading, tokens

tiktoken = pytest.importorskip("tiktoken")

ODD = ["", " ", "\n\n \t", "a", "the quick brown fox's 1234  jumps", "über straße 中文字符 🙂🙃 é\u0301", "\x00\x01\u200b<|endoftext|>", "x" * 5000, "ab " * 3000, "\u00a0\u3000 \r\n", "I'll we've DON'T", "�\ud7ff\U0010ffff"]


@pytest.fixture(scope="module")
def enc():
    return tokens.Encoder(tokens.vocabulary())


def test_encoder_equals_reference_vocabulary(enc):
    ref = tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=tokens.load_ranks(tokens.vocabulary()), special_tokens={})
    r = random.Random(4)
    texts = ODD + ["".join(chr(r.choice([r.randrange(32, 127), r.randrange(160, 0x2FFF), r.randrange(0x4E00, 0x9FFF), r.randrange(0x1F300, 0x1F9FF)])) for _ in range(r.randrange(1, 80))) for _ in range(400)]
    for t in texts:
        ids = enc.encode(t)
        assert ids == ref.encode_ordinary(t)
        assert "".join(tokens.decode(enc.machine, ids)) == t


def test_stream_holds_back_unfinished_characters():
    s = tokens.Utf8Stream()
    data = "aé中🙂".encode()
    assert "".join(s.feed(data[i : i + 1]) for i in range(len(data))) == "aé中🙂"
    assert s.feed(b"\xf0\x9f") == "" and s.feed(b"", final=True) == "\ufffd"


def test_encode_table(spark, enc):
    rows = [(i, t, i) for i, t in enumerate(ODD)] + [(98, None, 1), (99, ODD[4], 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids long")
    got = {r.doc_id: list(r.ids) for r in tokens.encode(df, "doc_id", "text").collect()}
    assert got == {i: enc.encode(t) for i, t, _ in rows} and got[98] == [] and got[0] == []
    assert tokens.encode(df.limit(0), "doc_id", "text").count() == 0
    assert all(r.same for r in tokens.round_trip(df, "doc_id", "text").collect())


# --- leakage ---

WORDS = [f"{a}{b}{c}" for a in ("ka", "mo", "tri", "vel", "su") for b in ("lo", "ni", "ba", "re") for c in ("x", "nd", "sk", "ty", "m")]


def make_items(n=8):
    r = random.Random(7)
    return {i: "Read the notes about the graph below and answer in one short paragraph. " * (i % 2) + " ".join(r.choice(WORDS) + ("," if r.random() < 0.1 else "") for _ in range(60)) for i in range(n)}


def test_leaks(spark, rows):
    items = make_items()
    w = {i: t.replace("Read the notes about the graph below and answer in one short paragraph. ", "").split() for i, t in items.items()}
    odd = lambda ws: " ".join(x if k % 7 else "well " + x for k, x in enumerate(ws))
    filler = "Some ordinary words about nothing in particular stand here. "
    docs = {
        1: filler + items[0], 2: filler * 3 + " ".join(w[2][10:35]), 3: " ".join(w[2][:10]), 4: filler + odd(w[4]).upper(), 5: "<b>" + "</b>\n> **".join(w[1][:30]) + "**", 6: " ".join(x[:2] + "\u00ad" + x[2:] for x in w[3][:30]),
        7: " ".join(w[5][:13]) + ". " + filler * 4 + " ".join(w[5][20:33]), 8: "Read the notes about the graph below and answer in one short paragraph. " + filler, 9: None, 10: "", 11: " ".join(reversed(w[6])), 12: " ".join(w[0][:30]) + filler + " ".join(w[7][:30]), 13: items[0],
        14: "中文。" * 50 + "\u3000".join(w[6][:25]), 15: (filler * 4000) + " ".join(w[6][:25]),
    }
    df = spark.createDataFrame(list(docs.items()) + [(1, docs[1])], "doc_id long, text string")
    it = spark.createDataFrame([(i, "s", t) for i, t in items.items()] + [(50, "s", None), (51, "s", " "), (None, "s", items[0]), (52, "s", items[0]), *[(60 + k, "s", items[3]) for k in range(6)]], "item_id long, suite string, text string")
    got = {(r.doc_id, r.item_id) for r in leakage.leaks(df, it).collect()}
    want = {(1, 0), (1, 52), (2, 2), (4, 4), (5, 1), (6, 3), (7, 5), (12, 0), (12, 7), (12, 52), (13, 0), (13, 52), (14, 6), (15, 6)} | {(6, 60 + k) for k in range(6)}
    assert got == want
    assert rows(leakage.leaks(df.limit(0), it)) == [] and rows(leakage.leaks(df, it.limit(0))) == []


def frames(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


def leaked(spark, docs, items, **how):
    return {(r.doc_id, r.item_id) for r in leakage.leaks(*frames(spark, docs, items), **how).collect()}


def nonsense(seed, n):
    r = random.Random(seed)
    return [f"{r.choice('bcdfg')}{r.choice('aeiou')}{r.choice('klmnp')}{r.randrange(10_000)}" for _ in range(n)]


def held_brute(doc, item, least=leakage.MIN_WORDS):
    """Every shingle of the document against every one of the item, no index and no prefix."""
    d, i = leakage.shingles(leakage.words(doc)), leakage.shingles(leakage.words(item))
    return leakage.held(*np.nonzero(d[:, None] == i[None]), least) if len(d) and len(i) else 0


@pytest.mark.parametrize("how", [{}, {"held_words": 0}])
def test_against_every_pair(spark, how):
    """Index in the executors and shuffle join give what holding every document against every item gives, whatever stands between the words."""
    r = random.Random(11)
    items = [(i, " ".join(r.choice(WORDS + ["the", "of", "and", "in"] * 8) for _ in range(r.choice([12, 25, 60, 300])))) for i in range(25)] + [(90, items_ := " ".join(nonsense(1, 40)))]
    docs = []
    for i, t in items:
        w = t.split()
        for every in (2, 3, 4, 6, 50):
            n = r.choice([8, 21, 30, 45])
            at = r.randrange(max(1, len(w) - n + 1))
            docs.append((len(docs), " ".join(["so it goes"] * r.randrange(4) + [x + " odd" * (k % every == every - 1) for k, x in enumerate(w[at : at + n])] + ["and that is it"])))
    docs += [(900, docs[3][1] + " well " + docs[70][1]), (901, " ".join(d for _, d in docs)), (902, " ".join(items_.split()[:10] + ["x"] * 40 + items_.split()[20:33]))]
    want = {(d, i) for d, t in docs for i, u in items if held_brute(t, u)}
    assert leaked(spark, docs, items, **how) == want and (902, 90) in want and len(want) > 60


def test_odd_words_every_few_words(spark):
    """Passages of 20 words with a word put in after every 2 to 6 words, and of 30 with every third to seventh word replaced."""
    w = nonsense(2, 60)
    docs = []
    for every in range(2, 7):
        for at in range(0, 40, 10):
            docs.append((len(docs), " ".join(x + " odd" * (k % every == every - 1) for k, x in enumerate(w[at : at + 20]))))
        for at in range(0, 31, 10):
            docs.append((len(docs), " ".join("odd" if k % (every + 1) == every else x for k, x in enumerate(w[at : at + 30]))))
    assert leaked(spark, docs, [(1, " ".join(w))]) == {(d, 1) for d, _ in docs}


def test_shared_passages_and_added_items_change_nothing(spark):
    """A passage inside three, four or seventy items stands for each of them; items that reuse an item's words one by one take nothing away, nor do 20,000 more items."""
    shared, alone = nonsense(3, 30), nonsense(4, 25)
    for many in (3, 4, 70):
        items = [(i, " ".join(nonsense(100 + i, 20) + shared + nonsense(300 + i, 20))) for i in range(many)] + [(999, " ".join(alone))]
        # others that reuse each triple of the item found alone
        items += [(2000 + k, " ".join(nonsense(5000 + k, 15) + alone[k % 23 : k % 23 + 3] + nonsense(7000 + k, 15))) for k in range(69)]
        docs = [(1, "x y z " + " ".join(shared)), (2, " ".join(alone)), (3, " ".join(nonsense(9, 40)))]
        assert leaked(spark, docs, items) == {(1, i) for i in range(many)} | {(2, 999)}
    more = [(10_000 + k, " ".join(nonsense(50_000 + k, 25))) for k in range(20_000)]
    assert leaked(spark, docs, items + more) == {(1, i) for i in range(70)} | {(2, 999)}


def test_instructions_are_openings_that_go_on_differently(spark):
    said = "Read the notes about the code graph below and answer in one short paragraph saying why it is so"
    tails = {i: nonsense(800 + i, 40) for i in range(8)}
    docs = [(1, said + " " + " ".join(tails[0][:8])), (2, " ".join(tails[1][:25])), (3, said)]
    items = [(i, said + " " + " ".join(t)) for i, t in tails.items()]
    assert leaked(spark, docs, items) == {(2, 1)}
    # fewer items than an instruction needs: their opening is part of them
    assert leaked(spark, docs, items[:3]) == {(1, 0), (2, 1)} | {(3, i) for i in range(3) if held_brute(said, items[i][1])} | {(1, i) for i in range(3) if held_brute(docs[0][1], items[i][1])}


def test_copies_are_one_item(spark):
    """Copies that differ in case, spacing and punctuation, near-copies with an odd word, and a repeated id with another text; a real instruction stays one."""
    items = make_items(12)
    w = {i: t.split() for i, t in items.items()}
    spelled = [items[0].upper(), "  ".join(w[0]), ", ".join(w[0]), items[0] + "!", "<b>" + items[0] + "</b>"]
    odd = [" ".join(w[2][:k] + ["other"] + w[2][k + 1 :]) for k in (12, 22, 32, 42, 52)]
    asked = [(i, t) for i, t in items.items()] + [(100 + k, t) for k, t in enumerate(spelled)] + [(200 + k, t) for k, t in enumerate(odd)] + [(0, items[4])]
    docs = [(1, "x y z " + items[0]), (2, "x y z " + " ".join(w[2][:30])), (3, items[1][:72] + " x y z"), (4, items[4])]
    assert leaked(spark, docs, asked) == {(1, 0), (2, 2), (4, 0), (4, 4)} | {(1, 100 + k) for k in range(5)} | {(2, 200 + k) for k in range(5)}


def test_found_against_brute_force():
    """Contiguous passages of every length: those of at least the threshold are found, those of ten words are not."""
    for t in make_items(4).values():
        w = leakage.words(t)
        for n in (10, 20, 31, len(w)):
            for at in range(0, len(w) - n + 1, 7):
                got = held_brute(" ".join(["so"] * 5 + w[at : at + n] + ["and"] * 5), t)
                assert got >= n if n >= leakage.MIN_WORDS else got == 0


def test_stretches_in_order():
    """Against all orders of a few stretches."""
    from itertools import combinations

    r = random.Random(5)
    for _ in range(200):
        s = [(a := r.randrange(30), b := r.randrange(30), a + r.randrange(1, 9), b + r.randrange(1, 9), r.randrange(1, 20)) for _ in range(r.randrange(0, 7))]
        best = 0
        for n in range(len(s) + 1):
            for c in combinations(sorted(s), n):
                if all(x[2] <= y[0] and x[3] <= y[1] for x, y in zip(c, c[1:])):
                    best = max(best, sum(x[4] for x in c))
        assert leakage._in_order(s) == best


# --- reading level ---

EASY = "The dog runs to the red house and the cat sits on a big box. We go home and you can see it now. "
MIDDLE = "After the upgrade, a background worker writes a warning to the log because the parser output changed since yesterday. "
HARD = "Notwithstanding considerable theoretical difficulties, the methodological reliability of interprocedural characterisation remains contentious. "


def graded(spark, n=8):
    mix = lambda s, k: " ".join(s.split()[k % 3 :] + s.split()) * 3
    rows = [(100 * b + k, mix(t, k), b) for b, t in ((1, EASY), (2, MIDDLE), (3, HARD)) for k in range(n)]
    return spark.createDataFrame(rows + [(1, None, 1), (2, "x", None), (3, "", 2)], "sample_id long, text string, band int")


def test_levels(spark, rows):
    code = "```\n" + "def the_house(): return HARD\n" * 40 + "```\n"
    table = "| the | dog |\n|---|---|\n" + "| notwithstanding | methodological |\n" * 30
    docs = [
        (1, EASY * 4), (2, MIDDLE * 5), (3, HARD * 5), (4, "# Title\n\n" + EASY * 4 + "\n\n" + code + table), (5, "Der Hund ist nicht im Haus und die Katze sitzt auf der Mauer. " * 10), (6, EASY), (7, None), (8, ""), (9, code), (10, HARD * 6 + "\n\n" + EASY), (11, "图书馆很大。" * 40), (12, EASY * 3000), (3, HARD * 5), (13, (EASY * 2 + "\n\n" + code + "\n" + HARD * 6).replace("\n", "\r\n")),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r.band for r in reading.levels(df, graded(spark)).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 1, 10: 3, 12: 1, 13: 3}
    assert rows(reading.levels(df, graded(spark).limit(0))) == [] and rows(reading.levels(df.limit(0), graded(spark))) == []


# The same passage in languages no list of the operator names.
ELSEWHERE = {
    "nl": "De gebruiker kan in het menu een nieuwe taak maken en deze later weer openen. Het programma is snel en werkt ook als er geen verbinding met de server is. We hebben in de laatste versie een paar fouten hersteld en is de tekst in de handleiding beter geworden, want er was veel vraag naar een uitleg in een of ander boek.",
    "fr": "Le programme lit les fichiers du projet et construit un graphe des appels entre les fonctions. Il est possible de chercher un nom dans toutes les sources sans attendre la fin de la lecture, et la page se charge aussi quand le serveur ne répond pas encore à la demande.",
    "it": "Il programma legge i file del progetto e costruisce un grafo delle chiamate fra le funzioni. Non serve aspettare la fine della lettura per cercare un nome, e la pagina si apre anche quando il server non risponde ancora alla domanda che gli è stata fatta poco prima.",
    "pt": "O programa lê os ficheiros do projeto e constrói um grafo das chamadas entre as funções. Não é preciso esperar pelo fim da leitura para procurar um nome, e a página abre também quando o servidor ainda não responde ao pedido que lhe foi feito pouco antes disso.",
    "sv": "Programmet läser filerna i projektet och bygger en graf över anropen mellan funktionerna. Det går att söka efter ett namn utan att vänta på att allt har lästs, och sidan öppnas även när servern ännu inte har svarat på frågan som ställdes strax innan av någon annan.",
    "da": "Programmet læser filerne i projektet og bygger en graf over kald mellem funktionerne. Man kan søge efter et navn uden at vente på at alt er læst, og siden åbner også når serveren endnu ikke har svaret på det spørgsmål som blev stillet lige før af en anden person.",
    "pl": "Program czyta pliki projektu i buduje graf wywołań między funkcjami. Nie trzeba czekać na koniec czytania, aby wyszukać nazwę, a strona otwiera się także wtedy, gdy serwer jeszcze nie odpowiedział na pytanie, które ktoś inny zadał mu chwilę wcześniej tego dnia.",
    "id": "Program ini membaca berkas proyek dan membangun graf panggilan antara fungsi. Anda tidak perlu menunggu sampai semua selesai dibaca untuk mencari sebuah nama, dan halaman tetap terbuka ketika peladen belum menjawab pertanyaan yang diajukan orang lain sebelumnya pada hari itu.",
    "fi": "Ohjelma lukee projektin tiedostot ja rakentaa verkon funktioiden välisistä kutsuista. Nimeä voi etsiä odottamatta, että kaikki on luettu, ja sivu avautuu myös silloin, kun palvelin ei ole vielä vastannut kysymykseen, jonka joku toinen esitti hetkeä aikaisemmin samana päivänä.",
}
PLAIN = "The program reads the files of a project and builds a graph of the calls between its functions. You can look for a name in all sources without waiting for the end of the reading, and the page opens even when the server has not yet answered a question that someone else asked a little earlier that day."


def test_english_is_told_from_languages_not_named():
    pd = pytest.importorskip("pandas")
    import os

    path = "/root/testdata/sf0.001/graded_texts.parquet"
    if not os.path.exists(path):
        pytest.skip("no test data")
    g = pd.read_parquet(path)
    m = reading.fit(list(zip(g["text"], g["band"])))
    assert {k for k, t in ELSEWHERE.items() if reading.judge(t, m) is not None} == set()
    assert reading.judge(PLAIN, m) is not None and reading.judge(ELSEWHERE["nl"] + "\n\n" + PLAIN + " " + PLAIN, m) is not None and reading.judge(PLAIN + "\n\n" + ELSEWHERE["sv"] + " " + ELSEWHERE["sv"], m) is None


def test_held_out_accuracy():
    """Graded texts of the test data, each judged by a model that has not seen it."""
    pd = pytest.importorskip("pandas")
    import os

    path = "/root/testdata/sf0.001/graded_texts.parquet"
    if not os.path.exists(path):
        pytest.skip("no test data")
    g = pd.read_parquet(path)
    texts = list(zip(g["text"], g["band"]))
    right = 0
    for k, (t, b) in enumerate(texts):
        m = reading.fit(texts[:k] + texts[k + 1 :])
        w = [x for p in reading.prose(t) for x in reading._WORD.findall(p.lower())]
        right += m.band([m.grades[x] for x in w if x in m.grades]) == b
    assert right >= 0.95 * len(texts)


# --- provenance ---

FUNC = "def {0}(a, b):\n    if a is None:\n        return {1}\n    return a + {1}\n"


def hand(n, salt):
    return "import os\n\n" + "\n\n".join(FUNC.format(f"f{salt}_{w}", n + k) for k, w in enumerate(("alpha", "beta", "gamma")))


def test_content_classes():
    c = provenance.content_class
    msg = "public class Msg {\n" + "".join(f"    public int get{w}{i}() {{ return f[{i}]; }}\n" for i, w in enumerate("ABCDEFGHIJ")) + "}\n"
    cases = {
        "generated": [("a.go", "// Code generated by x v1. DO NOT EDIT.\npackage a\n"), ("a.py", "# Copyright Own\n#\n# This file was automatically generated from x.idl\n" + hand(1, 1)), ("A.java", msg), ("a.ts", "".join(f"export const OP_{i} = {i * 7};\n" for i in range(12)))],
        "minified": [("a.js", "!function(){" + "".join(f"function a{i}(t){{return t*{i}}}" for i in range(60)) + "}();")],
        "vendored": [("a.py", "# Bundled copy of lib 1.2.3. Report bugs upstream.\n" + hand(1, 2)), ("a.js", "/*! lib v1.2 | MIT */\nfunction f(a, b) {\n  return a;\n}\n"), ("a.go", "// lib 1.3.0 - (c) the lib project, see https://lib\npackage lib\n")],
        "data": [("a.py", "T = [" + "1, " * 300 + "]\n"), ("a.js", 'export const X = "' + "aGVsbG8" * 60 + '";\n'), ("a.py", "R = [\n" + "  [1, 2, 3],\n" * 60 + "]\n")],
        "": [("a.py", hand(1, 3)), ("a.py", 'BANNER = "// Code generated by x. DO NOT EDIT."\n' + hand(1, 3)), ("a.py", "# Tokens are generated lazily; do not edit the cache by hand.\n" + hand(1, 3)), ("a.py", "T = [" + "1, " * 300 + "]\n\n" + hand(1, 3)), ("a.json", '{"a": ' + "[1]" * 1 + "}"), ("a.py", None), ("a.py", "  ")],
    }
    for want, files in cases.items():
        for path, text in files:
            assert c(path, text) == want, (path, (text or "")[:60])


def test_vendored_mark_behind_a_long_licence(spark):
    licence = "# Permission is granted to any person, free of charge, to deal in this text.\n" * 130
    assert len(licence) > 10_000
    for mark in ("Copied from https://lib.example/a.py", "upstream: https://lib.example", "imported from https://lib.example", "lib 1.3.0 - (c) lib people", "!lib v1.2"):
        assert provenance.content_class("a.py", licence + "# " + mark + "\n" + hand(1, 4)) == "vendored", mark
    assert provenance.content_class("a.py", licence + hand(1, 4)) == ""
    src = [("r1/a.py", licence + "# upstream: https://lib.example\n\n" + hand(1, 5)), ("r1/b.py", hand(1, 5)), ("r1/c.py", licence + hand(2, 6))]
    assert {r.path: r.reason for r in provenance.judged(spark.createDataFrame(src, "path string, content string")).collect()} == {"r1/a.py": "vendored", "r1/b.py": "vendored"}


@pytest.mark.parametrize("run", ["-" * 300_000, "x" * 300_000, "#\n" * 150_000, "!-" * 150_000, "#!\n" * 100_000])
def test_long_heads_take_one_pass(run):
    at = time.process_time()
    assert not provenance._VENDORED.search("# a\n" + run)
    assert time.process_time() - at < 5


def states(path, files):
    return provenance.declared(path, files)


def test_attribute_precedence():
    root = "*.pb.go linguist-generated\nlib/** linguist-vendored=true\nlib/own/*.py -linguist-vendored\nlib/own/b.py !linguist-vendored\n# x\n*.txt text\n"
    files = {"r": root, "r/x": "*.pb.go linguist-generated=false\nlate.pb.go linguist-generated"}
    assert states("r/a/b.pb.go", files) == {"generated": "set"} and states("r/x/b.pb.go", files) == {"generated": "unset"} and states("r/x/late.pb.go", files) == {"generated": "set"}
    assert states("r/lib/a/b.py", files) == {"vendored": "set"} and states("r/lib/own/a.py", files) == {"vendored": "unset"} and states("r/lib/own/b.py", files) == {"vendored": "unspecified"} and states("r/b.py", files) == {}


@pytest.mark.parametrize(
    "pattern, hits, misses",
    [
        ("*.js", ["a.js", "x/y/a.js", ".js"], ["a.jsx", "a.js/b"]), ("/a.js", ["a.js"], ["x/a.js"]), ("x/*.js", ["x/a.js"], ["x/y/a.js", "z/x/a.js"]), ("x/**", ["x/a", "x/y/a"], ["x", "y/x/a"]), ("**/x/*.js", ["x/a.js", "y/z/x/a.js"], ["x/y/a.js"]),
        ("a/**/b.js", ["a/b.js", "a/x/y/b.js"], ["ab.js", "xa/b.js"]), ("lib/", [], ["lib", "lib/a.js", "x/lib/a.js"]), ("[ab].js", ["a.js", "x/b.js"], ["c.js", "[ab].js"]), ("[!a]x.js", ["bx.js"], ["ax.js", "y/x.js"]), ("[a-c0-9]?.go", ["b1.go", "7x.go"], ["d1.go", "b.go"]),
        ("[[:digit:]].py", ["7.py"], ["d.py"]), ("a\\*.js", ["a*.js"], ["ab.js"]), ('"a b.js"', ["a b.js", "x/a b.js"], ["a", "b.js"]), ('"q\\"\\303\\251.js"', ['q"é.js'], ["q.js"]), ("[ab", [], ["a", "[ab"]), ("!*.js", [], ["a.js", "!a.js"]), ("a.js", ["a.js", "b/a.js"], ["aXjs"]),
    ],
)
def test_attribute_patterns(pattern, hits, misses):
    got = lambda p: states("r/" + p, {"r": f"{pattern} linguist-generated\r\n"})
    assert all(got(p) == {"generated": "set"} for p in hits) and all(got(p) == {} for p in misses)


def test_attribute_macros_and_values():
    text = "[attr]made linguist-generated -diff\n*.a made\n*.b linguist-generated=true linguist-vendored=0\n*.c -linguist-generated linguist-generated\n*.d linguist-generatedx xlinguist-vendored\n"
    assert states("r/x.a", {"r": text}) == {"generated": "set"} and states("r/x.b", {"r": text}) == {"generated": "set", "vendored": "unset"} and states("r/x.c", {"r": text}) == {"generated": "set"} and states("r/x.d", {"r": text}) == {}
    assert states("r/s/x.a", {"r": "", "r/s": text}) == {}  # macros are defined in a root file only


def test_declared_in_tables(spark):
    """Attribute files of several folders and repositories meet their paths; each attribute clears its own kind only; declared files are proof for patterns elsewhere."""
    lib = "// Bundled copy of lib 1.2.3. Report bugs upstream.\n"
    src = [
        ("a/.gitattributes", "out/** linguist-generated\nout/keep/*.py -linguist-generated\n*.lib.py -linguist-generated\n"), ("a/out/keep/.gitattributes", "z.py linguist-generated\n"), ("a/out/m.py", hand(1, 41)), ("a/out/keep/n.py", "# @generated by tool\n" + hand(1, 42)), ("a/out/keep/z.py", hand(1, 43)), ("a/x.lib.py", lib.replace("//", "#") + hand(1, 44)),
        ("b/.gitattributes", "*.stub.py linguist-generated\n*.lib.py -linguist-vendored\n"), ("b/y.lib.py", lib.replace("//", "#") + hand(1, 45)), ("b/z.min.lib.py", "# @generated by tool\n" + hand(1, 46)), *[(f"b/p{k}.stub.py", hand(k, 50 + k)) for k in range(3)],
        ("c/.gitattributes", "*.stub.py linguist-generated\nown.stub.py -linguist-generated\n"), *[(f"c/q{k}.stub.py", hand(k, 60 + k)) for k in range(3)], ("c/own.stub.py", hand(1, 70)),
        ("d/e/r.stub.py", hand(1, 71)), ("d/e/own.py", hand(1, 72)), (".gitattributes", "top.py linguist-vendored\n"), ("top.py", hand(1, 73)), *[(f"e{k}/generated/vendor/h.py", hand(k, 80 + k)) for k in range(3)],
    ]
    df = spark.createDataFrame(src, "path string, content string")
    want = {"a/out/m.py": "declared", "a/out/keep/z.py": "declared", "a/x.lib.py": "vendored", "b/z.min.lib.py": "generated", "top.py": "declared", "d/e/r.stub.py": "mined"} | {f"b/p{k}.stub.py": "declared" for k in range(3)} | {f"c/q{k}.stub.py": "declared" for k in range(3)}
    for bound in (provenance.ATTRIBUTE_FILES, 0):
        provenance.ATTRIBUTE_FILES, was = bound, provenance.ATTRIBUTE_FILES
        try:
            assert {r.path: r.reason for r in provenance.judged(df).collect()} == want
        finally:
            provenance.ATTRIBUTE_FILES = was


def test_judged(spark, rows):
    lib = hand(5, 9)
    src = [(f"r{i}/vendor/lib/a{i}.py", lib) for i in range(6)] + [(f"r{i}/gen/h{i}.py", hand(i, 20 + i)) for i in range(6)] + [(f"r{i}/proto/x.txt.ts", "// @generated by tool\nexport const a = 1;\n") for i in range(6)]
    src += [("r1/proto/late.txt.ts", "export function f() {\n  return 1;\n}\n"), ("r1/copied.py", lib), ("q/.gitattributes", "own/** linguist-generated=false\nmade/** linguist-generated\n"), ("q/own/a.ts", "// @generated by tool\nexport const a = 1;\n"), ("q/made/a.py", hand(3, 77)), ("q/made/a.json", "{}"), (None, lib), ("q/n.py", None), ("q/e.py", ""), ("q/made/a.py", hand(3, 77))]
    df = spark.createDataFrame(src, "path string, content string")
    got = {r.path: r.reason for r in provenance.judged(df).collect()}
    assert {p for p in got if "/vendor/" in p} == {f"r{i}/vendor/lib/a{i}.py" for i in range(6)}
    assert got["r1/copied.py"] == "vendored" and got["r1/proto/late.txt.ts"] == "mined" and got["q/made/a.py"] == "declared"
    assert not any("/gen/" in p or p in ("q/own/a.ts", "q/made/a.json", "q/n.py", "q/e.py") for p in got)
    assert rows(provenance.judged(df.limit(0))) == []
    assert json.dumps(sorted(got)) == json.dumps(sorted(set(got)))
