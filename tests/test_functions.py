import random
import re

import duckdb
import pytest

from linkwright.catalog_sql import _phonetic
from linkwright.functions import similarity as S
from linkwright.functions import text as T
from linkwright.functions.tables import INDIA_REGIONS


def run(spark, f, values):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, x string").orderBy("i").select(f("x")).collect()
    return [r[0] for r in rows]


GOLDEN = [
    (T.transliterate, {"राम मार्केटिंग": "ram marketing", "ಶಿವ್ ಎಂಟರ್‌ಪ್ರೈಸಸ್": "shiv entarpraisas", "గుజరాత్ Logistics": "gujarat Logistics", "സിൽവർ": "silvar", "plain ascii": "plain ascii"}),
    (T.clean_text, {"राम मार्केटिंग प्राइवेट लिमिटेड": "ram marketing praivet limited", "Société Générale": "societe generale", "S.A.R.L. Dupont & Fils": "sarl dupont and fils", None: ""}),
    (T.name_tokens, {"ltd ontime pvt services": ["ontime", "services"], "m s ashutoshbrosprivate com": ["ashutoshbrosprivate"], "anselma s holdings id 14307": ["anselma", "s", "holdings"], "ram marketing praivet limited": ["ram", "marketing"], "llc": ["llc"]}),
    (T.fix_leet, {"s0reis": "soreis", "5ervices": "services", "127a": "127a", "3rd": "3rd", "2024": "2024"}),
    (T.address_tokens, {"h number 127a colonial circle null": ["127a", "127", "colonial", "circle"], "007 000": ["7", "0"]}),
    (T.core_name, {"foo co ltd": "foo co", "acme pvt ltd": "acme", "inc": ""}),
    (T.legal_suffix, {"foo co ltd": "ltd", "acme pvt ltd": "pvt ltd", "acme": ""}),
    (T.india_region_codes, {"andheri mumbai maharashtr 400": "andheri mumbai mh 400", "in tamil nadu or": "in tn or", "": ""}),
    (T.us_region_codes, {"nome north carolina ca": "nome nc ca"}),
    (T.id_list, {" a, b,,c ": ["a", "b", "c"], None: []}),
]


@pytest.mark.parametrize("f,cases", GOLDEN, ids=lambda x: getattr(x, "__name__", ""))
def test_golden(spark, f, cases):
    assert run(spark, f, list(cases)) == list(cases.values())


def test_phonetic_bridges(spark):
    words = ["global", "kulopal", "business", "pichinas", "enterprises", "entarpraisas", "software", "sophtaveyar", "1122", ""]
    keys = run(spark, T.phonetic_key, words)
    assert keys[0:8:2] == keys[1:8:2] and keys[8:] == ["12", ""]
    rng = random.Random(1)
    some = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz12") for _ in range(rng.randint(1, 9))) for _ in range(300)]
    each = run(spark, T.phonetic_key, some)
    assert run(spark, T.phonetic_key, [" ".join(some)]) == [" ".join(each)]
    assert [duckdb.execute(f"SELECT {_phonetic('x')} FROM (SELECT ? AS x)", [w]).fetchone()[0] for w in some] == each


def test_india_regions_by_brute_force(spark):
    """Texts read from the left, the longest run of words that is a name first."""
    names = {name: code for code, spelled in INDIA_REGIONS.items() for name in spelled if len(name) > 2}
    heard = dict(zip(run(spark, T.phonetic_key, [n.replace(" ", "") for n in names]), names.values(), strict=True))
    rng = random.Random(2)
    parts = [*names, "or", "ct", "12", "dilhi", "gujrat", "maharashtr", "karnatak", "nagar", "haveli", "and", "west", "islands", "tamil", "7b", "diu"]
    texts = [" ".join(rng.choice(parts) for _ in range(rng.randint(0, 9))) for _ in range(120)] + ["", "goa " * 400 + "goa"]
    runs = sorted({" ".join(ws[i : i + w]) for ws in map(str.split, texts) for i in range(len(ws)) for w in range(1, 9)})
    sounds = dict(zip(runs, run(spark, T.phonetic_key, [r.replace(" ", "") for r in runs]), strict=True))

    def code(ws):
        joined = " ".join(ws)
        if set(map(str.isdigit, ws)) != {False}:
            return None
        return names.get(joined) or (heard.get(sounds[joined]) if min(len(joined), len(sounds[joined])) >= 5 else None)

    def read(text):
        out, ws = "", text.split()
        while ws:
            n = next((w for w in range(min(8, len(ws)), 0, -1) if code(ws[:w])), 0)
            out += " " + (code(ws[:n]) if n else ws[0])
            del ws[: n or 1]
        return out[1:]

    assert run(spark, T.india_region_codes, texts) == [read(t) for t in texts]
    assert run(spark, T.india_region_codes, [None, "goa", "x 5 goa5"]) == [None, "ga", "x 5 goa5"]


def test_postal_code(spark):
    rows = [("India", "x 560001", "560001"), ("india", "x 060001", ""), ("US", "a 02139-1234", "02139"), ("france", "75001 Paris", "75001"), ("peru", "x 123456", "123456"), ("us", None, "")]
    df = spark.createDataFrame(rows, "c string, a string, want string")
    assert all(r[0] == r[1] for r in df.select(T.postal_code("a", "c"), "want").collect())


def table_lcs(a, b):
    best = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, best[j] = best[j], last + 1 if x == y else max(best[j], best[j - 1])
    return best[-1]


def test_similarities():
    rng = random.Random(2)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc ") for _ in range(rng.randint(0, 12))) for _ in range(2))
        assert S.lcs(a, b) == table_lcs(a, b)
    assert S.lcs("kitten", "sitting") == 4
    assert S.token_set("a b", "b a c") == 1 and S.token_set("", "a") == 0 and S.partial("abc", "xxabcxx") == 1
    assert round(S.jaro_winkler("martha", "marhta"), 4) == 0.9611 and S.indel("", "") == 1 and S.partial_token_set("a b", "b c") == 1


def test_region_scan_starts_only_where_a_name_may(spark):
    names = [n for spelled in INDIA_REGIONS.values() for n in spelled if len(n) > 2]
    pattern = re.compile(T._beginnings(names))
    assert all(pattern.search(n.split()[0]) for n in names)
    assert all(pattern.search(w) for w in ("m", "mah", "kharnatak", "ph", "xyz", "Andhra", "uththar"))
    assert not any(pattern.search(w) for w in ("12", "street", "floor", "road", "thing", "zebra"))


def test_partial_of_many_equals_one_by_one():
    rng = random.Random(3)
    some = lambda letters, n: "".join(rng.choice(letters) for _ in range(rng.randint(0, n)))
    pairs = [(some("ab ", 9), some("abc", 9)) for _ in range(2000)] + [(some("abé中𝒜", 5), some("abé中", 8)) for _ in range(2000)] + [("ab" * 70, "ba" * 70 + "a" * (i % 2)) for i in range(20)]
    assert list(S.partial_many(pairs)) == [S.partial(a, b) for a, b in pairs]
