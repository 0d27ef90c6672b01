import datetime

import pytest

from mnemograph.llm import names, queries
from mnemograph.llm.near_duplicates import all_pairs

SCHEMA = "entity_id bigint, entity_type string, name string, updated_time timestamp_ntz, form string, kind string, core string"
DAY = datetime.datetime(2024, 1, 1)


def test_fold():
    assert names.fold("Kûbé-kami_ki, Dr. O'Neil").split() == ["kube", "kami", "ki,", "dr", "oneil"]
    assert names.tokens_of("person", "Barbara Dabiropusol, M.D.") == {"before": ["barbara", "dabiropusol"], "after": []}
    assert names.tokens_of("organization", "The Bank of Nalu S. A.")["before"] == ["bank", "nalu"]
    assert names.tokens_of("organization", "GeneralHospitalofLoritenolath")["before"] == ["general", "hospital", "loritenolath"]
    assert names.tokens_of("person", " ") == {"before": [], "after": []}


def test_edits_and_abbreviations():
    assert names.one_edit("robert", "robret") and names.one_edit("robert", "robet") and names.one_edit("robert", "roberts")
    assert not names.one_edit("robert", "robert") and not names.one_edit("robert", "rebort") and not names.one_edit("ab", "abcd")
    assert names.abbreviates("genl", "general") and names.abbreviates("mfg", "manufacturing") and not names.abbreviates("hist", "hospital")


ROWS = {
    "sedora": ["Elizabeth Sedoramunek", "Sedoramunek, Elizabeth", "Liz Sedoramunek", "E. Sedoramunek", "Dr. ELIZABETH SEDORAMUNEK", "Elizabeth Sedoramnuek", "elizabeth sedoramunek, PhD"],
    "sedora2": ["Walter Sedoramunek", "Sedoramunek, Walt", "W. Sedoramunek"],
    "carl": ["Carl Pivotaneru", "Pivotaneru, Carl"],
    "carla": ["Carla Pivotaneru", "Pivotaneru, Carla", "Dr Carla Pivotaneru"],
    "bank": ["Bank of Lanotibes", "Lanotibes Bank plc", "The Bank of Lanotibes", "Lanotibes Bk."],
    "hospital": ["Lanotibes General Hospital", "General Hospital of Lanotibes", "Hospital General Lanotibes", "LANOTIBES GENL HOSP."],
    "steel": ["Gomusader Steel & Wire Corp.", "Gomusader Steel and Wire GmbH"],
    "ships": ["Gomusader Shipping Ltd", "Gomusader Shpg. Aktiengesellschaft"],
}


@pytest.fixture(scope="module")
def linked(spark):
    filler = []
    for i in range(40):
        for given in ("Carl", "Carla", "Elizabeth", "Walter"):
            last = "".join("bdgklmnprstv"[(i * 7 + k * 5 + len(given)) % 12] + "aeiou"[(i + k * k) % 5] for k in range(5)).capitalize()
            filler += [f"{given} {last}", f"{last}, {given}"]
        filler += ["Xo" + "".join("bdgklmnprstv"[(i * 5 + k) % 12] + "aeiou"[(i + k) % 5] for k in range(4)) + f" {w}" for w in ("Bank", "General Hospital", "Shipping")]
    rows, truth = [], {}
    for key, spellings in ROWS.items():
        for name in spellings:
            truth[len(rows)] = key
            rows.append((len(rows), "organization" if key in ("bank", "hospital", "steel", "ships") else "person", name, DAY, "", "", ""))
    for name in filler:
        rows.append((1000 + len(rows), "organization" if name.split()[-1] in ("Bank", "Hospital", "Shipping") else "person", name, DAY, "", "", ""))
    rows += [(5000, "person", None, DAY, "", "", ""), (5001, "person", " , ", DAY, "", "", ""), (5002, None, "Nobody Known", DAY, "", "", ""), (None, "person", "No Identity", DAY, "", "", "")]
    rows += [(5003, "location", "Bank of Lanotibes", DAY, "", "", ""), (5004, "person", "Walter Sedoramunek", DAY, "", "", ""), (5004, "person", "Carl Pivotaneru", DAY + datetime.timedelta(1), "", "", ""), rows[0]]
    rows += [(6000 + i, "person", "Hugo Copied", DAY, "", "", "") for i in range(90)] + [(7000, "person", "x" * 20_000, DAY, "", "", "")]
    out = names.linked_names(spark.createDataFrame(rows, SCHEMA))
    return truth, out.cache()


def test_links(linked):
    truth, out = linked
    group = {r.entity_id: r.group_id for r in out.collect()}
    for a in truth:
        for b in truth:
            assert (group[a] == group[b]) == (truth[a] == truth[b]), (a, b, truth[a], truth[b])
    assert group[5004] == group[next(i for i, k in truth.items() if k == "carl")]  # its latest delivery
    assert not {5000, 5001, 5002, 5003} & set(group) and 7000 in group
    assert out.count() == len(group)


def test_empty(spark):
    assert names.linked_names(spark.createDataFrame([], SCHEMA)).count() == 0


def test_all_pairs_of_many_ids(spark, tmp_path):
    """Of one person under more than 64 ids, and of a group in several salts, every pair comes."""
    names_of = ["Dr. John Smith, PhD", "john smith", "JOHN SMITH", "Smith, John"]
    rows = [(i, "person", names_of[i % 4], DAY, "", "", "") for i in range(100)] + [(200, "person", "Maud Other", DAY, "", "", "")]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/sag2_entity.parquet")
    pairs = [tuple(r) for r in queries.p1_found(spark, str(tmp_path)).collect()]
    assert sorted(pairs) == [(a, b) for a in range(100) for b in range(a + 1, 100)]
    many = spark.range(2500).selectExpr("id", "'g' AS group_id")
    assert all_pairs(many, "x").distinct().count() == all_pairs(many, "x").count() == 2500 * 2499 // 2


def test_slip_beside_a_common_own_name(spark):
    """The own name stands in more spellings than any cap, so the slip is the rarest word; a near own name stays apart."""
    trades = ["Insurance", "Brewery", "Shipping", "Steel", "Textile", "Mining", "Airlines", "Bank"]
    firms = [f"{a}{b}{c}" for a in ("Zor", "Mul", "Kap", "Dev") for b in ("at", "ik", "on") for c in ("el", "us", "ag", "im", "or")]
    rows = [f"{f} {t}" for f in firms for t in trades] + [f"Acme {t} {w}" for t in trades for w in ("Holding", "Group")] + [f"Acme {t}" for t in trades]
    rows += ["Acme Insurance"] * 5 + ["Acme Insruance", "Akme Insurance"]
    out = names.linked_names(spark.createDataFrame([(i, "organization", n, DAY, "", "", "") for i, n in enumerate(rows)], SCHEMA))
    group = {rows[r.entity_id]: r.group_id for r in out.collect()}
    assert group["Acme Insruance"] == group["Acme Insurance"]
    assert group["Acme Insurance"] not in (group["Akme Insurance"], group["Acme Bank"], group["Acme Insurance Group"])
    assert len({group[f"{f} Insurance"] for f in firms}) == len(firms)
