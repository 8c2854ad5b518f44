import datetime
import random
import re
import time

import regex
from pyspark.sql import functions as F

from numera.llm import pii

TEXTS = {
    1: None, 2: "", 3: "Nothing private here, chapter 12.", 4: "Mail Ann.Lee@mail3.example.com or ann.lee@mail3.example.com, not bob@x.org!",
    5: "Card 4111111111111111 and 4111-1111-1111-1111, from 10.20.30.40.", 6: "Call +1 (437) 555-0689 or 212-555-0101; SSN 078-05-1120.",
    7: 'x token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" y', 8: "Mr. John Smith met Mrs Smith. Then John Smith left; Dr. Иванова and госпожа Иванова stayed.",
    9: "GB29 NWBK 6016 1331 9268 19", 10: "see 1.2.3.4.5 and 999.1.1.1 and 12:30", 11: "ping 10.20.30.40 " * 3000, 12: "PASSWORD: hunterhunter2",
}


def rewritten(docs_of, rows=None):
    return {r.doc_id: r for r in pii.replace(docs_of(rows or [*TEXTS.items()])).collect()}


def test_formats(docs_of):
    got = rewritten(docs_of)
    assert got[1].text is None and got[2].text == "" and got[3].text == TEXTS[3] and got[10].text == TEXTS[10]
    assert [got[d].n_entities for d in (1, 2, 3, 10)] == [0] * 4
    a, b, c = re.findall(r"[\w.]+@[\w.]+", got[4].text)
    assert a.lower() == b and a[2].isupper() and c != b and got[4].text.startswith("Mail ") and b.endswith(".example.com") and got[4].kinds == "email"
    x, y, ip = re.fullmatch(r"Card (4\d{15}) and (4\d{3}-\d{4}-\d{4}-\d{4}), from (\d+\.\d+\.\d+\.\d+)\.", got[5].text).groups()
    assert x == y.replace("-", "") != "4" + "1" * 15
    digits = [int(d) for d in reversed(x)]
    assert (sum(digits[::2]) + sum(sum(divmod(2 * d, 10)) for d in digits[1::2])) % 10 == 0
    assert re.fullmatch(r"Call \+1 \([2-9]\d\d\) [2-9]\d\d-\d{4} or [2-9]\d\d-[2-9]\d\d-\d{4}; SSN \d{3}-\d{2}-\d{4}\.", got[6].text)
    assert re.fullmatch(r'x token = "[0-9a-f]{40}" y', got[7].text) and "04dbeb" not in got[7].text
    assert re.fullmatch(r"GB\d\d [A-Z]{4} \d{4} \d{4} \d{4} \d\d", got[9].text) and got[9].text != TEXTS[9]
    assert re.fullmatch(r"PASSWORD: [a-z]{12}\d", got[12].text)
    assert set(got[11].text.split()) == {"ping", ip} and got[11].n_entities == 3000
    assert not any(p in r.text for r in got.values() if r.text for p in ("mail3", "bob@", "10.20.30.40", "4111", "555", "078-05", "hunter"))


def test_names_keep_gender_script_and_coreference(docs_of):
    text = rewritten(docs_of)[8].text
    m = re.fullmatch(r"Mr\. (\w+) (\w+) met Mrs (\w+)\. Then (\w+) (\w+) left; Dr\. (\w+) and госпожа (\w+) stayed\.", text)
    given, smith, mrs, again, smith2, ivanova, ivanova2 = m.groups()
    assert smith == mrs == smith2 and given == again and given.endswith("n") and "Smith" not in text and "John" not in text
    assert ivanova == ivanova2 and re.fullmatch("[а-яА-Я]+", ivanova)


def test_distinct_entities_stay_distinct(spark, docs_of, monkeypatch):
    rows = [(i, f"from 10.0.{i // 200}.{i % 200 + 1} on") for i in range(400)]
    got = rewritten(docs_of, rows)
    assert len({r.text for r in got.values()}) == 400
    # a generator of 512 values makes clashes the rule; later attempts resolve them
    small = lambda seed: F.concat(F.lit("10.7.0."), (F.conv(F.substr(seed, F.lit(1), F.lit(3)), 16, 10).cast("int") % 512).cast("string"))
    monkeypatch.setattr(pii, "_ip", small)
    monkeypatch.setattr(pii, "ATTEMPTS", 12)
    few = {r.doc_id: r.text for r in pii.replace(docs_of(rows[:60])).collect()}
    assert len(set(few.values())) == 60
    parts = spark.createDataFrame([("ip", t.split()[1], t.split()[1]) for _, t in rows[:60]], "kind string, norm string, raw string")
    assert pii.attempts(parts, pii.KEY).count() > 0


def test_a_surrogate_is_no_other_entity(docs_of):
    first = rewritten(docs_of, [(1, "at 10.20.30.40 now")])[1].text.split()[1]
    both = rewritten(docs_of, [(1, "at 10.20.30.40 now"), (2, f"at {first} now")])
    assert both[1].text.split()[1] not in (first, "10.20.30.40") and both[2].text.split()[1] not in (first, "10.20.30.40")


def test_later_mentions_of_a_person_are_replaced_alike(docs_of):
    rows = [(1, "John Smith met Smith and JOHN SMITH. Smithers stayed; Jürgen Q. Weiß left, says Weiß."), (2, "Smith is a word here."), (3, "my name is Xu Yilong and Xu agrees"), (4, "Dear Sir Madam, Dear Ada Byron")]
    got = rewritten(docs_of, rows)
    m = re.fullmatch(r"(\w+) (\w+) met (\w+) and (\w+) (\w+)\. Smithers stayed; (\w+) [A-Z]\. (\w+) left, says (\w+)\.", got[1].text)
    given, smith, bare, upper_given, upper, _, weiss, weiss2 = m.groups()
    assert smith == bare and upper == smith.upper() and upper_given == given.upper() and weiss == weiss2 and got[1].n_entities == 6
    assert got[2].text == rows[1][1] and got[2].n_entities == 0
    assert re.fullmatch(r"my name is (\w+) \w+ and (\w+) agrees", got[3].text) and "Yilong" not in got[3].text
    assert got[4].text.startswith("Dear Sir Madam, Dear ") and "Byron" not in got[4].text and "Ada" not in got[4].text


def test_names_by_list_dates_addresses_and_numbers(docs_of):
    rows = [(1, "Wei Zhang wrote to Fatima Hassan and Alice Walker."), (2, "born 12/31/1980, DOB: 1980-12-30; geboren am 1.2.1975, born on 45/45/1980"), (3, "at 12 Main Street and 7, rue de Rivoli, or Hauptstraße 5a"), (4, "order 4111111111111112, card 4111111111111111, 9111111111111115")]
    got = rewritten(docs_of, rows)
    assert not re.search("Wei|Zhang|Fatima|Hassan|Alice|Walker", got[1].text) and got[1].kinds == "name" and got[1].n_entities == 3
    m = re.fullmatch(r"born (\d\d)/(\d\d)/(\d{4}), DOB: (\d{4})-(\d\d)-(\d\d); geboren am (\d\d)\.(\d\d)\.(\d{4}), born on \d\d/\d\d/\d{4}", got[2].text).groups()
    a, b = datetime.date(int(m[2]), int(m[0]), int(m[1])), datetime.date(*map(int, m[3:6]))
    assert (a - b).days == 1 and datetime.date(int(m[8]), int(m[7]), int(m[6])) < datetime.date(1975, 2, 1) and got[2].kinds == "birthdate"
    assert re.fullmatch(r"at \d\d [A-Z]\w+ Street and \d, rue de [A-Z]\w+, or [A-Z]\w+straße \d[a-z]", got[3].text) and not re.search("Main|Rivoli|Haupt", got[3].text)
    assert re.fullmatch(r"order 4111111111111112, card 4\d{15}, 9111111111111115", got[4].text) and "4111111111111111" not in got[4].text and got[4].n_entities == 1


def test_words_of_names_are_one_space(spark, monkeypatch):
    # surrogates of two letters: surnames and given names of either gender would meet
    monkeypatch.setattr(pii, "_made_up", lambda token, seed, gender, attempt: F.initcap(F.concat(pii._pick("abcdefgh", pii._byte(seed, F.lit(0))), pii._pick("mnop", pii._byte(seed, F.lit(1))))))
    parts = spark.createDataFrame([(k, f"w{i}", f"W{i}") for i, k in enumerate(["surname", "given_m", "given_f"] * 7)], "kind string, norm string, raw string")
    again = parts.join(pii.attempts(parts, "k"), ["kind", "norm"], "left").withColumn("attempt", F.coalesce("attempt", F.lit(0)))
    drawn = [r[0] for r in again.select(pii.surrogate("k", F.col("kind"), F.col("norm"), F.col("raw"), F.col("attempt"))).collect()]
    assert len(set(drawn)) == len(drawn) == 21


def brute(rows, spark):
    """Texts rewritten one by one: mentions by the patterns, bare names by word lists, surrogates asked for one entity each."""
    found, wanted = {}, set()
    for d, t in rows:
        cuts = [m.span() for m in regex.finditer(pii._ANY, t or "")]
        people = {}
        for a, b in cuts:
            if next(k for k, p in pii._WHOLE.items() if regex.fullmatch(p, t[a:b])) == "name":
                words = t[a:b].split(" ")
                if words[0].rstrip(".") in {x for own in pii.TITLES.values() for x in own.split()}:
                    words = words[1:]
                people.update({w.lower(): "surname" for w in words[-1:]})
                people.update({w.lower(): "given_" + next((g for g, own in pii.GIVEN.items() if w in own.split()), "n") for w in words[:-1]})
        free = [(m.start(), m.end()) for m in regex.finditer(r"[\p{L}\p{N}]+", t or "") if m[0].lower() in people and m[0][0].isupper() and (m[0][1:].islower() or m[0].isupper())]
        found[d] = t, cuts, [x for x in free if not any(a <= x[0] < b for a, b in cuts)], people
        wanted |= {(people[t[a:b].lower()], t[a:b].lower(), t[a:b]) for a, b in found[d][2]}
        for a, b in cuts:
            kind = next(k for k, p in pii._WHOLE.items() if regex.fullmatch(p, t[a:b]))
            if kind in ("email", "ip", "phone"):
                wanted.add((kind, t[a:b].lower() if kind == "email" else regex.sub("[ ()-]", "", t[a:b]) if kind == "phone" else t[a:b], t[a:b]))
            else:
                wanted |= {(people[w.lower()], w.lower(), w) for w in t[a:b].split(" ") if w.lower() in people}
    df = spark.createDataFrame(sorted(wanted), "kind string, norm string, raw string")
    made = {r.raw: r.out for r in df.select("raw", pii.surrogate(pii.KEY, F.col("kind"), F.col("norm"), F.col("raw"), F.lit(0)).alias("out")).collect()}
    out = {}
    for d, (t, cuts, free, _) in found.items():
        at, pieces = 0, []
        for a, b in sorted(cuts + free):
            pieces += [t[at:a], made[t[a:b]] if t[a:b] in made else " ".join(made.get(w, w) for w in t[a:b].split(" "))]
            at = b
        out[d] = "".join(pieces) + (t or "")[at:] if t is not None else None
    return out


def test_against_brute_force(spark, docs_of):
    rnd = random.Random(8)
    pieces = ["Alice Walker", "Walker", "WALKER", "Dr. Alice Walker", "a walker", "bob.jones@mail.example", "10.1.2.3", "+1 (437) 555-0689", "plain words", "Peter Weber", "Weber", "PETER", "peter", "x.y", "12", "(", "\n"]
    rows = [(i, " ".join(rnd.choice(pieces) for _ in range(rnd.randrange(1, 25)))) for i in range(60)] + [(100, None), (101, "")]
    want = brute(rows, spark)
    assert {r.doc_id: r.text for r in pii.replace(docs_of(rows)).collect()} == want


def test_hostile_texts_take_linear_time(docs_of):
    units = ["a-", "1 ", "A-", "Aa ", "a@", "token=", "1.", "born ", "Dear ", "+1 ", "12 Main ", "4111 ", "Mr. A", "é_"]
    docs = docs_of([(i, u * (200_000 // len(u)) + "7") for i, u in enumerate(units)], 1)
    began = time.perf_counter()
    got = pii.replace(docs).collect()
    assert len(got) == len(units) and time.perf_counter() - began < 60


def test_keys_and_repeats(docs_of):
    rows = [(1, TEXTS[4]), (1, TEXTS[4]), (None, TEXTS[4])]
    got = pii.replace(docs_of(rows)).collect()
    assert len(got) == 3 and len({r.text for r in got}) == 1
    assert pii.replace(docs_of(rows), key="other").first().text != got[0].text


def test_the_plan_is_native_and_empty_works(docs_of):
    assert pii.replace(docs_of([])).count() == 0
    plan = pii.replace(docs_of([*TEXTS.items()]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_short_formats_are_drawn_until_no_clash_is_left(spark):
    F = pii.F
    parts = spark.createDataFrame([("ssn", f"{i:02d}", f"{i:02d}") for i in range(0, 84, 2)], "kind string, norm string, raw string").coalesce(1)
    again = parts.join(pii.attempts(parts, "k"), ["kind", "norm"], "left").withColumn("attempt", F.coalesce("attempt", F.lit(0)))
    rows = again.select("norm", "attempt", pii.surrogate("k", F.col("kind"), F.col("norm"), F.col("raw"), F.col("attempt")).alias("drawn")).collect()
    drawn = {r.drawn for r in rows}
    assert len(drawn) == len(rows) == 42 and not drawn & {r.norm for r in rows} and max(r.attempt for r in rows) > 5
