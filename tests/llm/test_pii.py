import random
import re

from candlewick.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    total = 0
    for k, d in enumerate(reversed(digits)):
        d = int(d) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def brute(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    ok = {
        "email": lambda m: True,
        "ip": lambda m: all(int(x) <= 255 for x in m[0].split(".")),
        "card": lambda m: 12 <= len(digits(m)) <= 19 and luhn(digits(m)),
        "phone": lambda m: 9 <= len(digits(m)) <= 15,
    }
    found = [(m.start(), k, m.end()) for k, (kind, p) in enumerate(zip(ok, (EMAIL, IP, CARD, PHONE))) for m in p.finditer(text) if ok[kind](m)]
    return sorted(found)


def base(text):
    return [x for x in pii.spans_of(text) if x[1] < 4]


def test_base_equals_the_patterns_on_random_texts():
    random.seed(7)
    parts = ["a", "b.c", "@", ".", "-", " ", "+", "1", "22", "255", "256", "4111111111111111", "(", ")", "%", "é", "\n", "0", "+1 614 555 8001", "10.0.0.1", "token", "http://"]
    for _ in range(20000):
        text = "".join(random.choice(parts) for _ in range(random.randint(0, 14)))
        assert base(text) == brute(text), text


def test_added_kinds_and_masks():
    text = 'See https://a.example.com/x. Token = "9233A8ECF7C5B09FE5949719B6B82BC439E9329B"! Account no: 12345678.'
    kinds = [pii.KINDS[k] for _, k, _ in pii.spans_of(text)]
    assert kinds == ["url", "secret", "account"]
    assert pii.masked(text, pii.spans_of(text)) == 'See [URL]. Token = "[SECRET]"! Account no: [ACCOUNT].'


PROSE = ("was closed yesterday and then", "is", "a", "with 3 others", "in 2024", "(old)", "x", "- see below", "and 7 more", "to be paid")
NUMBERS = ("12345678", "1234 5678 9012", "123-45-6789", "AB1234567", "DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "GB82 WEST 1234 5698 7654 32", "00-11-22 33-44", "X9-12-3456-7")


def test_account_spans_take_no_prose():
    for number in NUMBERS:
        for tail in PROSE:
            for head in ("Account no: ", "account ", "IBAN is ", "ssn#", "Acct "):
                text = f"{head}{number} {tail}"
                found = [text[a:b] for a, k, b in pii.spans_of(text) if pii.KINDS[k] == "account"]
                expected = number if number != "00-11-22 33-44" else "00-11-22"
                assert found == [expected], text
    for text in ("account for 12 of them", "account 12345", "account 12 3456789", "iban DE89 3704 0044 0532 0130 01 was", "the accountant 12345678", "bankaccount 12345678"):
        found = [text[a:b] for a, k, b in pii.spans_of(text) if pii.KINDS[k] == "account"]
        assert found in ([], ["3456789"], ["3704 0044 0532 0130 01"]) and not (found and text.startswith(("account", "bank"))), text
    assert pii.masked("Account no: 12345678 was closed", pii.spans_of("Account no: 12345678 was closed")) == "Account no: [ACCOUNT] was closed"


def account_brute(text, at):
    """Of all that may follow a cue: the longest bank account number, else the longest group of numbers, else the longest word."""
    at += len(re.match(r"(?:\s*(?:number|no\.?|nr\.?|code|is|#|:|=))*\s*", text[at:], re.I)[0])
    ends = [e for e in range(at + 1, min(len(text), at + 50) + 1) if not re.match("[A-Za-z0-9]", text[e : e + 1])]

    def bank(x):
        y = x.replace(" ", "")
        whole = re.fullmatch("[A-Za-z]{2}[0-9]{2}[A-Za-z0-9]{11,30}", y) and "  " not in x and x == x.strip()
        return whole and all(re.search("[0-9]", g) for k, g in enumerate(x.split(" ")) if k != 1) and int("".join(str(int(c, 36)) for c in y[4:] + y[:4])) % 97 == 1

    digits = lambda x: len(re.findall("[0-9]", x))
    grouped = lambda x: re.fullmatch("[0-9]{2,4}( [0-9]{2,4})+", x) and digits(x) >= 6
    word = lambda x: re.fullmatch("[A-Za-z]{0,2}[0-9][A-Za-z0-9]*(-[A-Za-z0-9]*)*", x) and all(digits(p) for p in x.split("-"))
    for kind in (bank, grouped, word):
        if fits := [e for e in ends if kind(text[at:e])]:
            e = max(fits)
            return (at, e) if digits(text[at:e]) >= 6 and len(text[at:e]) <= 34 else e
    return None


def added_brute(text):
    out, free = [], 0
    for m in re.finditer("(?=(account|acct|iban|ssn|passport|routing))", text):
        if m.start() >= free and not (m.start() and text[m.start() - 1].isalnum()):
            found = account_brute(text, m.start() + len(m[1]))
            free = found[1] if isinstance(found, tuple) else found or free
            out += [(found[0], "account", found[1])] if isinstance(found, tuple) else []
    free = 0
    for m in re.finditer(r"(?=(https?://|ftp://)([^\s<>\"'`|\\^{}]+))", text):
        body = m[2].rstrip(".,;:!?)]*&%#$")
        if m.start() >= free:
            free = m.start() + len(m[1]) + len(body)
            out += [(m.start(), "url", free)] if "." in body.split("/")[0].strip(".") else []
    free = 0
    for m in re.finditer(r"""(?=(token|secret|password|api_key|apikey)\s*[:=]\s*(["']?)([A-Za-z0-9_./+=-]{12,})\2)""", text):
        if m.start() >= free:
            free = m.end(3)
            out += [(m.start(3), "secret", m.end(3))] if re.search("[0-9]", m[3]) else []
    return sorted(out)


def test_added_kinds_equal_brute_force_on_random_texts():
    random.seed(4)
    parts = ["account", "iban", "ssn", " ", " ", "no: ", "#", "1234", "56", "7", "-", "AB", "was", "x", ".", "DE89370400440532013000", "0044 0532", "http://", "https://", "a.b", "/", "token", "secret", " = ", ":", '"', "0123456789abcdef", "é", "\n"]
    for _ in range(20000):
        text = "".join(random.choice(parts) for _ in range(random.randint(0, 12)))
        assert sorted((a, pii.KINDS[k], b) for a, k, b in pii.spans_of(text) if k >= 4) == added_brute(text), text


def test_long_texts_are_read_whole(spark):
    text = "Lorem 12 ipsum. " * 100_000 + "a@b.example " + "1" * 50_000
    (row,) = pii.detect(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert [(x.kind, x.start) for x in row.spans] == [("email", 1_600_000)]


def test_empty_and_null_and_extra_columns(spark):
    df = spark.createDataFrame([(1, None, 5), (2, "", 6), (2, "", 6), (3, "x a@b.c", 7)], "doc_id long, text string, spans int")
    rows = sorted((r.doc_id, [(s.kind, s.start, s.end) for s in r.spans]) for r in pii.detect(df).collect())
    assert rows == [(1, []), (2, []), (2, []), (3, [("email", 2, 7)])]
    masked = sorted((r.doc_id, r.text, r.spans) for r in pii.mask(df).collect() if r.doc_id != 2)
    assert masked == [(1, None, 5), (3, "x [EMAIL]", 7)]
    assert pii.detect(df.limit(0)).count() == 0
