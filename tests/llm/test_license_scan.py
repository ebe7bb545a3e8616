import random
import re

from texts import SCHEMA, frame, rows

from splatspark.llm import license_scan


def plain(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places, labels = [], set()
    for phrase, label in license_scan.PHRASES:
        p = phrase.split()
        at = [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
        places += at
        labels |= {label} if at else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_phrases(spark):
    texts = [
        "The MIT License.", "mit license MIT-LICENSE mit mit license", "GNU General Public License; general public domain license", "apache licenseé", "Apache\nLicense 2.0 " * 50,
        "general general public license license public general", "MIT", "", None, "mit Kense license",
    ]
    data = [(i, t, None, None, None, "a", "b", "c") for i, t in enumerate(texts)] + [(len(texts) + r[0], *r[1:]) for r in rows() if r[0] is not None]
    data.append((None, "mit license", *[None] * 6))
    got = {(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in license_scan.scanned(spark.createDataFrame(data, SCHEMA)).collect()}
    assert got == {(d[0], *plain(d[1])) for d in data}
    assert license_scan.scanned(spark.createDataFrame(data, SCHEMA)).count() == len(data)
    assert license_scan.scanned(frame(spark, [])).count() == 0


def test_notices_are_found_with_small_changes(spark):
    notice = license_scan.NOTICES[0][0].split()
    changed = notice[:10] + ["extra", "words"] + notice[10:30] + notice[31:]
    texts = {1: " ".join(["intro"] * 9 + changed + ["end"]), 2: " ".join(notice[:12]), 3: " ".join(x for w in notice for x in (w, "pad")), 4: "Licensed under CC BY-NC 4.0."}
    got = {r.doc_id: r for r in license_scan.scanned(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")).collect()}
    assert got[1].labels == "mit-text" and 0.75 <= got[1].score < 1 and got[1].spans[0].first == 9
    assert (got[2].labels, got[3].labels, got[2].score) == ("", "", 0.0)
    assert (got[4].labels, got[4].base_labels, got[4].score) == ("cc-by-nc-4.0", "", 1.0)


def plain_spans(text):
    """Spans of notices by brute force: votes by diagonal, cut at gaps, chained in the order of the text."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    out = []
    for notice, label in license_scan.NOTICES:
        t = notice.split()
        votes = {}
        for i in range(len(words) - 1):
            for j in range(len(t) - 1):
                if words[i : i + 2] == t[j : j + 2]:
                    votes.setdefault(i - j, []).append(i)
        segments = []
        for d, at in votes.items():
            run = [at[0]]
            for x in at[1:] + [10**9]:
                if x - run[-1] > license_scan.MAX_GAP:
                    if len(run) >= min(license_scan.MIN_VOTES, len(t) - 1):
                        segments.append((run[0], d, run[-1] + 2, len(run)))
                    run = []
                run.append(x)
        islands = []
        for a, d, b, n in sorted(segments):
            if islands and abs(d - islands[-1]["d"]) <= license_scan.MAX_DRIFT and a - islands[-1]["end"] <= license_scan.MAX_GAP and a - d > islands[-1]["place"]:
                islands[-1]["n"] += n
                islands[-1]["b"] = max(islands[-1]["b"], b)
            else:
                islands.append({"a": a, "b": b, "n": n})
            islands[-1].update(d=d, end=b, place=b - 2 - d)
        out += [(x["a"], x["b"], label) for x in islands if x["n"] >= license_scan.MIN_SHARE * (len(t) - 1) and x["b"] - x["a"] <= 1.5 * (len(t) - 1) + license_scan.MAX_DRIFT]
    return sorted(out)


def test_spans_against_brute_force(spark):
    """Notices told twice, beside stray pairs of themselves, changed, cut and mixed."""
    rng = random.Random(3)
    notices = [n.split() for n, _ in license_scan.NOTICES]
    texts = [" ".join(notices[0]) + " the software z" * 20, "all rights reserved " * 3, " ".join(notices[0] + ["x"] * 3 + notices[0]), "the software z " * 20 + " ".join(notices[0]), None, ""]
    for _ in range(120):
        words = []
        for _ in range(rng.randrange(1, 4)):
            part = list(rng.choice(notices))
            for _ in range(rng.randrange(4)):
                at = rng.randrange(len(part))
                part[at : at + rng.randrange(3)] = rng.choice([[], ["pad"], ["the", "software"], rng.choice(notices)[:4]])
                part = part or ["pad"]
            words += rng.choice([[], ["stray"] * 15, ["of", "the", "software"] * 4]) + part
        texts.append(" ".join(words))
    got = {r.doc_id: r for r in license_scan.scanned(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)).collect()}
    for i, text in enumerate(texts):
        base = {label for _, label in license_scan.PHRASES}
        want = plain_spans(text)
        assert [(s.first, s.last, s.label) for s in got[i].spans if s.label not in base] == want, text
        assert got[i].labels == ",".join(sorted({x[2] for x in want} | set(filter(None, plain(text)[4].split(",")))))
    assert [got[i].labels for i in range(4)] == ["mit-text", "all-rights-reserved", "mit-text", "mit-text"]
    assert [len(got[i].spans) for i in range(4)] == [1, 3, 2, 1] and got[0].score == 1.0
