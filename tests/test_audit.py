"""The release audit: a whole release has no violation, and each planted fault is found under its own code."""

import hashlib
import json

import pytest

from skarn.operators.audit import audit_release


def sha(raw):
    return hashlib.sha256(raw if isinstance(raw, bytes) else raw.encode()).hexdigest()


def canonical(value):
    return json.dumps(value, ensure_ascii=False, sort_keys=True, indent=2) + "\n"


class Release:
    """A small whole release; `change` may alter its parts before the hashes are taken, `after` the files written."""

    def __init__(self, folder, change=None, after=None):
        self.root = folder / "release-7"
        ids = {"release_id": "r7", "run_id": "u1", "schema_version": "2.0"}
        keys = [{"system": s, "model": "m", "seed": k, "case_id": c} for s in ("full", "base") for k in (1, 2) for c in ("c1", "c2")]
        identity = {"paper_id": "p", "seed": 1, "note": None, "options": {"k": None, "deep": [1, 2.5]}}
        condition = sha(canonical({k: v for k, v in identity.items() if v is not None}))
        row = lambda k, i: {**k, **ids, "status": "ERROR" if i == 3 else "SUCCESS", "condition_sha256": condition}
        config = ids | {"study_status": "READY", "dataset": {"sha256": "d", "evidence_class": "measured", "claim_status": "current"}, "systems": [{"name": "full"}, {"name": "base"}], "models": [{"tag": "m"}], "seeds": [1, 2], "metrics": [{"name": "recall", "denominator": "all_expected"}, {"name": "mrr", "denominator": "answered"}]}
        groups = [{"n_expected": 4, "n_cases": 2, "metric_case_denominators": {"recall": 2, "mrr": 1}}]
        counts = {"SUCCESS": 7, "ERROR": 1}
        self.docs = {
            "config": config, "protocol": {"steps": 3}, "summary": ids | {"n_expected": 8, "status_counts": counts, "metric_names": ["recall", "mrr"], "groups": groups},
            "manifest": ids | {x: config[x] for x in ("dataset", "systems", "models", "seeds")} | {"evidence_class": "measured", "claim_status": "current", "lifecycle_status": "VALIDATED", "n_expected": 8, "status_counts": counts},
            "provenance": {"schema_version": "2.0"},
        }
        self.expected, self.raw, self.scored = list(keys), [row(k, i) | {"identity": identity} for i, k in enumerate(keys)], [row(k, i) for i, k in enumerate(keys)]
        self.files, self.note = {}, ""
        if change:
            change(self)
        lines = lambda rows: "".join(json.dumps(r) + "\n" for r in rows)
        self.docs["config"].setdefault("protocol_sha256", sha(canonical(self.docs["protocol"])))
        summary = canonical(self.docs["summary"])
        self.docs["provenance"].setdefault("aggregate_sha256", sha(summary))
        files = {"expected/rows.jsonl": lines(self.expected), "raw/rows.jsonl": lines(self.raw), "scored/rows.jsonl": lines(self.scored), "aggregates/summary.json": summary, "tables/summary.csv": f"# {sha(summary)}\nrecall\n", "tables/summary.tex": f"% {sha(summary)}\n{self.note}"}
        files |= self.files
        self.docs["manifest"].setdefault("artifacts", [{"path": p, "sha256": sha(t)} for p, t in files.items()])
        files |= {"configs/release_config.json": canonical(self.docs["config"]), "configs/protocol.json": canonical(self.docs["protocol"]), "manifest.json": canonical(self.docs["manifest"]), "tables/provenance.json": canonical(self.docs["provenance"])}
        files = {p: t for p, t in files.items() if t is not None}
        files["checksums.sha256"] = "".join(f"{sha(t)}  {p}\n" for p, t in files.items())
        for p, t in files.items():
            (self.root / p).parent.mkdir(parents=True, exist_ok=True)
            (self.root / p).write_text(t)
        if after:
            after(self.root)


def audit(spark, folder, change=None, after=None, **more):
    r = Release(folder, change, after)
    return sorted((x.code, x.subject) for x in audit_release(spark, f"file://{r.root}", **more).collect())


def test_a_whole_release_has_no_fault(spark, tmp_path):
    assert audit(spark, tmp_path, forbidden=["old-run"], private=[r"/home/\w+"]) == []


def put(document, **values):
    return lambda r: r.docs[document].update(values)


def at(rows, i, **values):
    return lambda r: getattr(r, rows)[i].update(values)


K3 = "full/m/2/c2"
FAULTS = [
    (put("summary", run_id="u2"), ["documents disagree on the release"]),
    (put("provenance", schema_version="1.0"), ["documents disagree on the schema version"]),
    (put("config", study_status="NOT_STARTED"), ["config is not READY", "template"]),
    (put("config", protocol_sha256="x"), ["protocol differs from its hash"]),
    (put("manifest", lifecycle_status="PLANNED"), ["lifecycle is incomplete"]),
    (put("manifest", claim_status="stale"), ["empirical release is not current", "manifest classification differs"]),
    (lambda r: (r.docs["config"]["dataset"].update(evidence_class="toy"), r.docs["manifest"].update(evidence_class="toy")), ["toy release is classified as one"]),
    (put("manifest", dataset={"sha256": "other"}), ["manifest dataset differ"]),
    (put("manifest", systems=[]), ["manifest systems differ"]),
    (put("manifest", models=[{"tag": "n"}]), ["manifest models differ"]),
    (put("manifest", seeds=[2, 1]), ["manifest seeds differ"]),
    (put("manifest", experiment={"id": 1}), ["manifest experiment differ"]),
    (put("summary", n_expected=9), ["number of expected rows differs"]),
    (put("manifest", status_counts={"SUCCESS": 8}), ["manifest status counts differ"]),
    (put("summary", status_counts={"SUCCESS": 6, "ERROR": 2}), ["aggregate status counts differ"]),
    (put("summary", metric_names=["mrr", "recall"]), ["metric names differ"]),
    (lambda r: r.docs["summary"]["groups"][0].update(n_expected=0), ["group without expected rows"]),
    (lambda r: r.docs["summary"]["groups"][0]["metric_case_denominators"].update(recall=1), ["metric dropped a case denominator"]),
    (put("provenance", aggregate_sha256="x"), ["provenance has a stale aggregate hash"]),
    (lambda r: r.files.update({"tables/summary.csv": "recall\n"}), ["tables/summary.csv lacks the aggregate hash"]),
    (lambda r: r.scored.pop(3), ["scored key is missing"]),
    (lambda r: r.scored.append(r.scored[3]), ["scored key is repeated"]),
    (lambda r: r.expected.pop(3), ["number of expected rows differs", "raw key is not expected", "scored key is not expected"]),
    (at("raw", 3, release_id="r6"), ["raw row is of another release"]),
    (at("scored", 3, schema_version="1.0"), ["scored row has another schema version"]),
    (at("scored", 3, status="SUCCESS"), ["raw and scored status differ"]),
    (at("scored", 3, condition_sha256="x"), ["raw and scored condition differ"]),
    (at("raw", 3, identity={"paper_id": "q"}), ["row identity differs from its condition hash"]),
    (lambda r: setattr(r, "note", "see old-run of /home/me"), ["forbidden: old-run", "private"]),
    (lambda r: r.files.update({"notes/x.md": '{"artifact_type": "template"}'}), ["template"]),
    (put("manifest", artifacts=[]), ["artifact hash missing or stale"] * 5),
]


@pytest.mark.parametrize("change,codes", FAULTS, ids=[c[0] for _, c in FAULTS])
def test_planted_faults(spark, tmp_path, change, codes):
    found = audit(spark, tmp_path, change, forbidden=["old-run"], private=[r"/home/\w+"])
    assert [c for c, _ in found] == codes
    assert all(s in ("", K3) or "." in s for _, s in found)


def test_faults_of_files(spark, tmp_path):
    def after(root):
        (root / "tables/summary.tex").write_text((root / "tables/summary.tex").read_text() + "%\n")
        (root / "configs/protocol.json").unlink()
        (root / "more.md").write_text("more")

    assert audit(spark, tmp_path, None, after) == [
        ("artifact hash missing or stale", "tables/summary.tex"), ("checksum mismatch", "tables/summary.tex"), ("file is not in the inventory", "more.md"), ("listed file is missing", "configs/protocol.json"), ("protocol is missing", ""),
    ]
    (tmp_path / "b").mkdir()
    assert audit(spark, tmp_path / "b", None, lambda root: (root / "manifest.json").unlink()) == [("release is incomplete", "manifest.json")]
    (tmp_path / "c").mkdir()
    assert ("no JSON: manifest.json", "") in audit(spark, tmp_path / "c", None, lambda root: (root / "manifest.json").write_text("{"))
