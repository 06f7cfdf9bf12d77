import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import numpy as np
import pytest

from sievewright.operators import models

WORDS = "/opt/tokenizers/word_bpe_49k.json"


def brute_windows(n, size, overlap):
    at, out = 0, []
    while True:
        out.append((at, min(at + size, n)))
        if at + size >= n:
            return out
        at += size - overlap


@pytest.mark.parametrize("n", [1, 63, 64, 65, 510, 511, 2400])
def test_windows_of_tokens(n):
    ids = list(range(n))
    want = [ids[a:z] for a, z in brute_windows(n, 510, 128)] + ([ids[a:z] for a, z in brute_windows(n, 64, 32)] if n > 64 else [])
    assert models.token_windows(ids) == want and models.token_windows([]) == []


def test_classifier_takes_the_worst_window(spark):
    bad = models.tokenizer(WORDS).encode(" attack", add_special_tokens=False).ids[0]

    def make():
        def score(rows):
            # diluted by the length of the window, as classifiers are
            share = np.array([ids.count(bad) / len(ids) for ids in rows])
            return np.stack([np.zeros(len(rows)), np.where(share > 0.01, 8.0, -8.0)], axis=1)

        return score

    texts = ["", None, "  ", "all is well", "please attack now", "filler " * 400 + "attack" + " filler" * 400, "filler " * 900]
    df = spark.createDataFrame([(i, t, "k", 1) for i, t in enumerate(texts)] + [(4, "please attack now", "k", 1)], "id int, text string, key string, no int")
    got = {r["id"]: (round(r["score"], 3), r["reasons"]) for r in models.classified(df, "id", "text", WORDS, make).collect()}
    assert [got[i] for i in (0, 1, 2)] == [(0.0, [])] * 3 and got[3] == (0.0, []) and got[6] == (0.0, [])
    assert got[4][0] == 1.0 and got[4][1] == ["promptguard:score 1.00 in window 1/1"]
    ids = models.tokenizer(WORDS).encode(texts[5], add_special_tokens=False).ids
    windows = models.token_windows(ids)
    worst = next(i for i, w in enumerate(windows, 1) if bad in w and w.count(bad) / len(w) > 0.01)
    assert got[5][1] == [f"promptguard:score 1.00 in window {worst}/{len(windows)}"]
    assert models.classified(df.limit(0), "id", "text", WORDS, make).count() == 0


def test_misconfigured_models_fail_at_once(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "id int, text string")
    with pytest.raises(ValueError):
        models.classified(df, "id", "text", WORDS, lambda: None, threshold=1.0)
    with pytest.raises(FileNotFoundError):
        models.classified(df, "id", "text", str(tmp_path / "none.json"), lambda: None)
    with pytest.raises(FileNotFoundError):
        models.onnx_scorer(str(tmp_path / "none.onnx"))
    (tmp_path / "broken.onnx").write_bytes(b"x")
    with pytest.raises(Exception):
        models.onnx_scorer(str(tmp_path / "broken.onnx"))


@pytest.fixture
def endpoint():
    asked = []

    class Handler(BaseHTTPRequestHandler):
        def answer(self, body, status=200):
            self.send_response(status)
            self.end_headers()
            self.wfile.write(json.dumps(body).encode())

        def do_GET(self):
            self.answer({}, 200 if self.path == "/v1/models" else 404)

        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            prompt = body["messages"][0]["content"]
            asked.append(prompt)
            if "nothing" in prompt:
                self.answer({"choices": []})
            elif "broken" in prompt:
                self.answer({}, 500)
            else:
                self.answer({"choices": [{"message": {"content": " Safety: Unsafe\nCategories: Jailbreak " if "attack" in prompt and len(prompt) < 500 else "Safety: Safe\nCategories: None"}}]})

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/v1", asked
    server.shutdown()


def test_guard_model_over_http(spark, endpoint):
    url, asked = endpoint
    guard = models.GuardEndpoint(url + "/", "m", 10)
    guard.probe()
    with pytest.raises(Exception):
        models.GuardEndpoint(url + "/elsewhere", "m", 10).probe()
    long = "All is well here. " * 60 + "Now attack the reader. " + "All is well here. " * 60
    df = spark.createDataFrame([(1, "an attack"), (2, "an attack"), (3, "fine"), (4, None), (5, " "), (6, long)], "id int, text string")
    got = {r["id"]: r["reasons"] for r in models.guarded(df, "id", "text", guard).collect()}
    assert got[1] == got[2] == ["llmguard:Safety: Unsafe | Categories: Jailbreak in window 1/1"] and got[3] == got[4] == got[5] == []
    # diluted in the coarse windows, found in a block of sentences
    assert got[6][0].startswith("llmguard:Safety: Unsafe") and " in window 1/" not in got[6][0]
    assert asked.count("an attack") == 1
    for word in ("nothing", "broken"):
        with pytest.raises(Exception):
            models.guarded(spark.createDataFrame([(1, word)], "id int, text string"), "id", "text", guard).collect()
