import hashlib

from radiokpi.llm import imatch


def edited(texts):
    out = []
    for k, text in enumerate(texts):
        n = len(text) // 4
        out.append(text[:len(text) - n] + texts[(k + 1) % len(texts)][:n])
    return out


def test_edited_texts_and_fingerprints(docs, awkward):
    texts = [t[1] if isinstance(t, tuple) else t for t in awkward]
    frame = docs([(k, t, "s") for k, t in enumerate(texts)])
    got = {r["doc_id"]: r for r in imatch.fingerprints(frame).collect()}
    whole = [t or "" for t in texts]
    assert len(got) == len(texts)
    for k, text in enumerate(edited(whole)):
        assert got[k]["n_chars"] == len(whole[k])
        assert got[k]["edited_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert 0 <= got[k]["near_edited"] <= 1 and 0 <= got[k]["near_next"] <= 1
    same = {}
    for k, text in enumerate(whole):
        assert same.setdefault(text, got[k]["fingerprint"]) == got[k]["fingerprint"]
    near = [got[k]["near_edited"] for k in range(40)]
    far = [got[k]["near_next"] for k in range(40)]
    assert sum(near) / 40 > 0.25 and sum(far) / 40 < 0.1


def test_ties_null_ids_and_no_rows(docs):
    rows = [(None, "a b c d", "s"), (1, "a b c d", "s"), (1, "a b c d", "s"), (1, "e f g", "s")]
    assert imatch.fingerprints(docs(rows)).count() == 4
    assert imatch.fingerprints(docs([])).count() == 0
    one = imatch.fingerprints(docs(["abcd efgh"])).first()
    assert one["near_next"] == 1.0 and one["edited_sha256"] == hashlib.sha256(b"abcd efab").hexdigest()


def test_order_over_many_buckets(docs):
    texts = [f"text number {k} " + "x" * (k % 50) for k in range(2600)]
    got = {r["doc_id"]: r["edited_sha256"] for r in imatch.fingerprints(docs([(3 * k, t, "s") for k, t in enumerate(texts)])).collect()}
    assert got == {3 * k: hashlib.sha256(t.encode()).hexdigest() for k, t in enumerate(edited(texts))}
