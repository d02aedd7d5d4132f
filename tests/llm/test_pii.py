import bisect
import hashlib
import math
import random
import re
from collections import Counter

import regex

from annospark.llm import pii
from annospark.llm.common import read

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def plain(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or "", re.ASCII):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")),
                "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]:
                out.append((kind, m.start(), m.end()))
    return out


def digest(spans):
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()


ODD = [
    None, "", "a@b.co a@b.co", "😀x@y.z.", "a@b.com_c@d.e", "a@b..c d@e.f", "a@b.c..d@e.f", "x@y", "a.b.@c-.d", "a@b@c.d", "1.2.3.4.5.6.7.8", "1.2.3", "300.1.1.1 0001.02.3.255",
    "4111 1111 1111 1111", "4111-1111-1111-1111-1", "4111  1111 1111 1111", "call +49 (030) 123-4567!", "+1+1 234 567 890", "+12 -", "é+33 1 23 45 67 89é\n+4",
    "." * 50 + "a@b" + ".c" * 20_000, "1 " * 30_000, "1." * 20_000, "x" * 100_000 + "@", "a@b.c " * 3000, "a@b.c1234567890123", "+1" + " 2" * 5, "4242424242424242" * 2,
]


def test_patterns(spark):
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choices("ab01 2.-@+()é_", weights=[2, 2, 4, 4, 3, 4, 4, 2, 3, 1, 1, 1, 1, 1], k=60)) for _ in range(3000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    for r in pii.base_spans(df).collect():
        got = [(k, s.start, s.end) for k in pii.KINDS for s in (r[k] or [])]
        assert got == plain(r.text), r.text[:80]


HEX = "9f3a5c1d7e2b4f60a8c1"


def test_terms_that_disclose(spark):
    rows = [(i, f"ask Zorbal, for ann@x.org now {i}", "q") for i in range(5)] + [(10 + i, f"ask some for words now number {i}", "q") for i in range(800)]
    rows += [(900, "zorbal ann@x.org then (zorbal) said the word zorbalx", "q"), (901, None, "q"), (902, "", "q"), (None, "mail ann@x.org", "q")]
    rows += [(900, "zorbal ann@x.org then (zorbal) said the word zorbalx", "q"), (903, "zorbal", "q"), (904, "far@y.org" + "\nzorbal", "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, term string")
    # 7 of 8 texts with zorbal... the default asks 0.9
    assert not any(r.term for r in pii.personal_data(df).collect())
    got = pii.personal_data(df, min_disclosure=0.7).collect()
    assert len(got) == len(rows)
    terms = {r.doc_id: [(s.start, s.end) for s in r.term or []] for r in got}
    assert terms[0] == [(4, 10)] and terms[900] == [(0, 6), (23, 29)]
    assert terms[10] == [] == terms[None] == terms[903] == terms[904]
    clean = {r.doc_id: r.text for r in pii.sanitised(df, min_disclosure=0.7).collect()}
    assert clean[0] == "ask [TERM], for [EMAIL] now 0" and clean[900] == "[TERM] [EMAIL] then ([TERM]) said the word zorbalx"
    assert clean[901] is None and clean[902] == "" and clean[10] == "ask some for words now number 0" and clean[None] == "mail [EMAIL]"
    assert pii.personal_data(df.filter("false")).collect() == [] == pii.sanitised(df.filter("false")).collect()


def test_a_name_in_its_own_line_of_eight_documents(spark):
    rows = [(i, f"filler text number {i}\nZorbal Miller, zorbal.miller@x0.org\nhelp {i}") for i in range(8)]
    rows += [(100 + i, f"help with filler text number {i}") for i in range(1000)]
    got = {r.doc_id: r for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i in range(8):
        at = rows[i][1].index("Zorbal")
        assert [(s.start - at, s.end - at) for s in got[i].term] == [(0, 6), (7, 13)]
    assert not got[100].term


def test_secrets(spark):
    rng = random.Random(5)
    secret = ["".join(rng.choices("0123456789abcdef", k=40)) for _ in range(6)]
    rows = [(i, f"set API_TOKEN =  '{s}' in it") for i, s in enumerate(secret)] + [(20, f"seen {secret[0]} here"), (21, f"build {HEX} passed"), (22, "a" * 39 + "1")]
    # copies are one witness, and one value is not enough
    rows += [(30 + i, "key: 0123456789abcdef0123") for i in range(5)]
    rows += [(100 + i, f"the token is in the build {i} key: {i}") for i in range(200)]
    got = {r.doc_id: [(r.text[s.start : s.end]) for s in r.secret or []] for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i] for i in range(6)] == [[s] for s in secret] and got[20] == [secret[0]]
    assert not any(got[i] for i in got if i > 20)


def test_cue_whose_word_ends_another_token(spark):
    """The name before a secret may itself be 16 signs or longer, and stand anywhere in the text."""
    rng = random.Random(7)
    secret = ["".join(rng.choices("0123456789abcdef", k=40)) for _ in range(24)]
    shapes = ["{} aws_secret_access_key = '{}' set", "{} AWS_SECRET_ACCESS_KEY={}", '{} "clientCredentialOfService": "{}"', "{} gespräch-zugangskennwörter: {}"]
    ahead = ["é😀" * n + "x" * (n % 2) for n in (0, 240, 251, 256, 500, 700)]
    rows = [(i, shapes[i % 4].format(ahead[i // 4], s)) for i, s in enumerate(secret)]
    rows += [(30, f"seen {secret[0]} here"), (31, f"aws_secret_access_code {HEX} passed")]
    rows += [(100 + i, f"the key and the service are in the build {i}") for i in range(300)]
    got = {r.doc_id: [r.text[s.start : s.end] for s in r.secret or []] for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i] for i in range(24)] == [[s] for s in secret] and got[30] == [secret[0]]
    assert not any(got[i] for i in got if i > 30)
    assert brute(t for _, t in rows)[1] == set(secret)


def test_signs_of_a_text_that_look_like_markers(spark):
    card = "4111111111111111"
    texts = [card + sign + card for sign in (pii.DOT, pii.GAP)] + [pii.GAP.join(["4111"] * 4), f"+49{pii.DOT}301234567", f"+49 301234567{pii.GAP}+1234567890", f"a@b.org{pii.DOT}c@d.org"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [(k, s.start, s.end) for k in pii.KINDS for s in (r[k] or [])] for r in pii.base_spans(df).collect()}
    assert got == {i: plain(t) for i, t in enumerate(texts)}
    assert got[0] == got[1] == [("card", 0, 16), ("card", 17, 33)]


def test_term_whose_lower_case_is_longer(spark):
    rows = [(i, f"ask İzmirli or Izmirli, for ann@x.org now {i}") for i in range(4)] + [(100 + i, f"ask some for Izmirli now or number {i}") for i in range(400)]
    got = {r.doc_id: [(s.start, s.end) for s in r.term or []] for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i] for i in range(4)] == [[(4, 11)]] * 4 and not got[100]


def test_odd_texts_through_the_whole_operator(spark):
    rows = [(i, t, "n") for i, t in enumerate(ODD)] + [(None, None, "n"), (7, "x" * 2_000_000, "n"), (8, f"token={HEX} " * 20_000, "n"), (9, "a@b.co " * 20_000, "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, secret string").repartition(8)
    assert pii.personal_data(df).count() == len(rows)
    assert pii.sanitised(df).columns == df.columns


# -- the definitions, in plain Python ------------------------------------------------

BEFORE, AFTER = r"(?<![\p{L}\p{M}\p{N}@_]|[\p{L}\p{N}]\.)", r"(?![\p{L}\p{M}\p{N}@_]|\.[\p{L}\p{N}])"
CUT = r"[\p{L}\p{M}\p{N}@_.]+"
WORD = regex.compile(BEFORE + r"\p{L}{2,}+" + AFTER)
TOKEN = regex.compile(r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9][A-Za-z0-9_+/-]{15,}+={0,2}")
BESIDE = regex.compile(r"(?<!\p{L})\p{L}++[^\p{L}\p{N}\n]{1,8}")


def carried(value):
    return -sum(n * math.log2(n / len(value)) for n in Counter(value).values())


def brute(texts):
    """Terms by entity, cues and secret values of different texts."""
    texts = set(texts)
    near, words, cue_texts, cue_values, with_cue = {}, Counter(), {}, {}, Counter()
    candidates = {}
    for text in texts:
        words.update({w.lower() for w in WORD.findall(text)})
        with_cue.update({regex.sub(r"\s+", " ", m[0].lower()) for m in regex.finditer(BESIDE.pattern + "(?=[A-Za-z0-9])", text)})
        by_kind = {}
        for kind, s, e in plain(text):
            by_kind.setdefault(kind, []).append((s, e))
        for kind, spans in by_kind.items():
            matches = [m for m in re.finditer(PLAIN[kind], text, re.ASCII) if kind != "card" or len(m[0]) >= 13]
            ends, starts = [0] + [m.end() for m in matches], [m.start() for m in matches] + [len(text)]
            for s, e in spans:
                # up to the line's ends, and to the next match of its kind
                left = text[max(ends[bisect.bisect_right(ends, s) - 1], s - pii.CONTEXT) : s]
                right = text[e : min(starts[bisect.bisect_left(starts, e)], e + pii.CONTEXT)]
                left = (regex.sub("^" + CUT, "", left) if len(left) == pii.CONTEXT else left).rsplit("\n", 1)[-1]
                right = (regex.sub(CUT + "$", "", right) if len(right) == pii.CONTEXT else right).split("\n", 1)[0]
                found = {w.lower() for w in WORD.findall(left + "@") + WORD.findall("@" + right)}
                near.setdefault(f"{kind}:{text[s:e].lower()}", {}).setdefault(text, set()).update(found)
        for m in TOKEN.finditer(text):
            if re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0]) and carried(m[0]) >= pii.MIN_BITS:
                candidates.setdefault(text, []).append(m[0])
                cue = [x[0] for x in BESIDE.finditer(text[: m.start()]) if x.end() == m.start()]
                if cue:
                    cue = regex.sub(r"\s+", " ", cue[0].lower())
                    cue_texts.setdefault(cue, set()).add(text)
                    cue_values.setdefault(cue, set()).add(m[0])
    told = {}
    for entity, at in near.items():
        for word, both in Counter(w for ws in at.values() for w in ws).items():
            share = both / words[word] if words[word] else 0
            if both >= pii.MIN_DOCS and share >= pii.MIN_DISCLOSURE and math.log2(share * len(texts) / len(at)) >= pii.MIN_PMI:
                told.setdefault(entity, set()).add(word)
    good = {c for c, at in cue_texts.items() if len(at) >= pii.MIN_DOCS <= len(cue_values[c]) and len(at) / with_cue[c] >= pii.MIN_DISCLOSURE
            and math.log2(len(at) / with_cue[c] * len(texts) / len(candidates)) >= pii.MIN_CUE_BITS}
    return told, set().union(*[cue_values[c] for c in good]) if good else set()


def test_query_on_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in read(spark, sf, "documents").collect()}
    got = pii.op5_pii(spark, sf).collect()
    assert len(got) == len(texts) and sum(r.n_email for r in got) > 10
    told, secrets = brute(t for t in texts.values() if t is not None)
    assert secrets
    for r in got:
        want = plain(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in want) for k in pii.KINDS]
        assert r.base_sha256 == digest(want)
        listed = r.spans.split(",") if r.spans else []
        assert listed[: len(want)] == [f"{k}:{s}:{e}" for k, s, e in want]
        text = texts[r.doc_id] or ""
        terms = set().union(*[told.get(f"{k}:{text[a:b].lower()}", set()) for k, a, b in want])
        more = [f"term:{m.start()}:{m.end()}" for m in WORD.finditer(text) if m[0].lower() in terms]
        more += [f"secret:{m.start()}:{m.end()}" for m in TOKEN.finditer(text) if m[0] in secrets]
        assert listed[len(want) :] == more
        assert r.n_spans == len(want) + len(more) and r.n_term + r.n_secret == len(more)
        if not r.n_spans:
            assert r.sanitised_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert sum(r.n_secret for r in got) > 5


def test_copies_are_one_witness_and_only_counts_travel(spark):
    """Rows by word and text never meet the wanted words: their join makes no more rows than there are words."""
    texts = [f"alpha beta {i} gamma" for i in range(40)] + ["alpha beta delta"] * 30 + ["", "beta"] * 2
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    wanted = pii.stored(spark.createDataFrame([("alpha",), ("delta",), ("beta",), ("none",)], "term string"), "wanted")
    found = pii._counted(docs, pii.TERM, wanted, "term")
    assert {r.term: r.in_all for r in found.collect()} == {"alpha": 41, "beta": 42, "delta": 1}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join Inner") < plan.index("Aggregate [term")  # the counts are made below the join
