import base64
import hashlib
import json
import pickle
import random
import threading
from http.client import HTTPConnection

import pytest

from tidemark.__main__ import as_json, inspect, simulate
from tidemark.plans.config import Config
from tidemark.service import BODY, serve
from tidemark.sinks import senders as N
from tidemark.sources.turns import simulated_turns
from tidemark.streaming.live import FileState, Live, MemoryState, StateError, features_of


def test_features_of_a_turn():
    values, samples = features_of({"inputTokens": float("nan"), "outputTokens": 5, "contextTokens": 10, "toolCalls": [{"name": "a", "ok": True}, {"name": "b", "ok": False}], "error": "", "finishReason": None})
    assert values == {"outputTokens": 5.0, "contextTokens": 10.0, "totalTokens": 5.0, "contextSnr": 0.5, "toolCallCount": 2.0, "toolFailureRate": 0.5, "errorRate": 1.0}
    assert samples == {"toolSelection": ["a", "b"]}
    assert features_of({"toolCalls": [], "error": None})[0] == {"toolCallCount": 0.0, "errorRate": 0.0}


def test_simulated_run_as_lines():
    lines = simulate(160, 30, None, 7)
    assert lines[0] == "simulation: turns=160 warmup=30 drift-at=96 seed=7"
    assert "turn 31 baseline.ready agent=sim-agent" in lines and "first detection: turn 139 (delay 43 turns)" in lines and "final behavior score: 74" in lines
    assert any(s.startswith("turn 113 forecast.detected feature=latencyMs") for s in lines)


def test_live_equals_batch(spark):
    from tidemark.operators import features, report
    from tidemark.sources.turns import simulate as rows

    cfg = Config(warmup=30)
    want = {r.seq: r for r in report.observed(features.wide(features.sequenced(rows(spark, [7], 160))), cfg).collect()}
    engine = Live(cfg)
    for t in simulated_turns(7, 160, 96):
        r, w = engine.observe(as_json(t)), want[engine.agents["sim-agent"].seq]
        assert (r["status"], r["severity"], r["behaviorScore"]) == (w.status, w.severity, w.behavior_score)
        assert [(a["feature"], a["contribution"], a["summary"]) for a in r["attributions"]] == [(a.feature, a.contribution, a.summary) for a in w.attributions]
        assert [f["summary"] for f in r["forecasts"]] == [f.summary for f in w.forecasts]


def test_state_goes_on(tmp_path):
    turns = [as_json(t) for t in simulated_turns(3, 150, 90)]
    whole, half = Live(Config(warmup=30)), Live(Config(warmup=30), FileState(str(tmp_path / "deep" / "s.json")))
    want = [whole.observe(t) for t in turns]
    for t in turns[:70]:
        half.observe(t)
    half.close()
    with pytest.raises(RuntimeError):
        half.observe(turns[0])
    rest = Live(Config(warmup=30), FileState(str(tmp_path / "deep" / "s.json")))
    assert [rest.observe(t) for t in turns[70:]] == want[70:]
    assert inspect(str(tmp_path / "deep" / "s.json"))[-1] == "total agents=1 observations=70"
    assert inspect(str(tmp_path / "none.json"))[0].startswith("no state found")
    for text in ("{", "[]", '{"version": 99, "agents": {}}'):
        (tmp_path / "bad.json").write_text(text)
        with pytest.raises(StateError):
            FileState(str(tmp_path / "bad.json")).load()
    with pytest.raises(ValueError):
        FileState("")


def test_alerts_listeners_and_limits():
    sent, events = [], []
    engine = Live(Config(warmup=30, max_agents=1), MemoryState(), {"ok": sent.append, "bad": lambda a: 1 / 0}, enrich=lambda a: {**a, "message": a["message"] + "\n\nIncident summary: x"})
    engine.on(lambda e: 1 / 0)
    off = engine.on(events.append)
    for t in simulated_turns(7, 160, 96):
        engine.observe({**as_json(t), "metadata": {"k": "v"}})
    assert engine.observe({"agentId": "other"})["behaviorScore"] == 100
    engine.flush()
    kinds = [e["kind"] for e in events]
    assert kinds[:3] == ["agent.registered", "observation.recorded", "baseline.learning"] and kinds.count("baseline.ready") == 1 and "error" in kinds and "state.persisted" in kinds
    assert sent and kinds.count("alert.dispatched") == kinds.count("alert.failed") == len(sent)
    assert sent[0]["message"].endswith("Incident summary: x") and sent[0]["metadata"] == {"k": "v"}
    off()
    n = len(events)
    engine.absorb("sim-agent")
    engine.close()
    engine.close()
    assert len(events) == n and engine.fingerprint_of("nobody") is None
    with pytest.raises(ValueError):
        Live().observe({"agentId": ""})


def test_service():
    server = serve(Live(), port=0, token="s")
    threading.Thread(target=server.serve_forever, daemon=True).start()

    def ask(method, path, body=None, token="s"):
        c = HTTPConnection("127.0.0.1", server.server_port, timeout=10)
        c.request(method, path, body, {"Authorization": f"Bearer {token}"} if token else {})
        r = c.getresponse()
        out = r.status, json.loads(r.read())
        c.close()
        return out

    try:
        assert ask("GET", "/healthz", token=None) == (200, {"ok": True})
        assert ask("GET", "/inspect", token=None)[0] == 401 and ask("GET", "/inspect", token="é")[0] == 401
        status, out = ask("POST", "/observe", json.dumps([{"agentId": "a", "latencyMs": 1}, {"agentId": "a"}]))
        assert status == 200 and [r["seq"] for r in out["reports"]] == [1, 2]
        assert ask("POST", "/observe", "{")[0] == 400 and ask("POST", "/observe", '[{"agentId": "b"}, 3]')[0] == 400
        assert ask("POST", "/observe", "x" * (BODY + 1))[0] == 413
        assert [a["agentId"] for a in ask("GET", "/inspect?x=1")[1]["agents"]] == ["a"]
        assert ask("GET", "/nowhere")[0] == 404 and ask("GET", "/observe")[0] == 404
    finally:
        server.shutdown()
        server.server_close()


class Net:
    """Answers by address, and what was asked."""

    def __init__(self, *answers):
        self.answers, self.asked = list(answers), []

    def __call__(self, method, url, headers, body):
        self.asked.append((method, url, headers, body.decode()))
        return self.answers.pop(0) if self.answers else (200, "{}")


def test_token_is_kept_and_asked_again():
    now = [0.0]
    net = Net((200, '{"access_token": "t1", "expires_in": 100}'), (200, ""), (200, ""), (401, "no"), (200, '{"access_token": "t2"}'), (200, ""))
    send = N.Sender({"reddit": {"client_id": "c", "client_secret": lambda: "s", "username": "u", "password": "p w", "subreddit": "r"}}, net, lambda: now[0])
    payload = '{"kind": "self", "title": "t", "text": "x"}'
    for _ in range(3):
        send("reddit", "1", payload)
    assert [url for _, url, _, _ in net.asked] == [N.REDDIT_TOKEN, N.REDDIT, N.REDDIT, N.REDDIT, N.REDDIT_TOKEN, N.REDDIT]
    assert net.asked[0][2]["Authorization"] == "Basic " + base64.b64encode(b"c:s").decode() and net.asked[0][3] == "grant_type=password&username=u&password=p+w"
    assert net.asked[5][2]["Authorization"] == "Bearer t2" and net.asked[5][3] == "sr=r&kind=self&title=t&text=x"
    now[0] = 3600 - 59
    send.transport = Net((200, "[]"))
    with pytest.raises(N.SendError, match="access_token"):
        send("reddit", "1", payload)
    assert pickle.loads(pickle.dumps(N.Sender({}))).tokens == {}


def test_signed_header():
    o = {"api_key": "k", "api_secret": "s e", "access_token": "t", "access_token_secret": "u"}
    header = N.signed_header(o, "POST", N.X, 7, "n")
    base = "POST&https%3A%2F%2Fapi.x.com%2F2%2Ftweets&oauth_consumer_key%3Dk%26oauth_nonce%3Dn%26oauth_signature_method%3DHMAC-SHA1%26oauth_timestamp%3D7%26oauth_token%3Dt%26oauth_version%3D1.0"
    import hmac

    want = base64.b64encode(hmac.new(b"s%20e&u", base.encode(), hashlib.sha1).digest()).decode()
    assert f'oauth_signature="{N.percent(want)}"' in header and header.startswith('OAuth oauth_consumer_key="k", ')


def prime(rng, bits):
    while True:
        n = rng.getrandbits(bits) | 1 | 3 << (bits - 2)
        if all(pow(a, n - 1, n) == 1 for a in (2, 3, 5, 7, 11)) and (n - 1) % 65537:
            return n


def tlv(tag, body):
    n = len(body)
    size = bytes([n]) if n < 128 else bytes([0x80 + (n.bit_length() + 7) // 8]) + n.to_bytes((n.bit_length() + 7) // 8, "big")
    return bytes([tag]) + size + body


def integer(n):
    return tlv(2, n.to_bytes(n.bit_length() // 8 + 1, "big"))


def test_service_account():
    rng = random.Random(5)
    p, q = prime(rng, 512), prime(rng, 512)
    n, e = p * q, 65537
    d = pow(e, -1, (p - 1) * (q - 1))
    key = tlv(0x30, b"".join(map(integer, (0, n, e, d, p, q, d % (p - 1), d % (q - 1), pow(q, -1, p)))))
    info = tlv(0x30, integer(0) + tlv(0x30, bytes.fromhex("06092a864886f70d0101010500")) + tlv(4, key))
    pem = "-----BEGIN PRIVATE KEY-----\n" + base64.encodebytes(info).decode() + "-----END PRIVATE KEY-----\n"
    assert N.rsa_numbers(pem) == (n, d)
    net = Net((200, '{"access_token": "g"}'))
    send = N.Sender({"googledocs": {"document_id": "D", "email": "a@b", "private_key": pem}}, net, lambda: 1000.0)
    for _ in range(2):
        send("googledocs", "1", '{"requests": [{"insertText": {"text": "x"}}]}')
    assert len(net.asked) == 3 and net.asked[2][2]["Authorization"] == "Bearer g"
    head, claims, signature = net.asked[0][3].split("assertion=")[1].split(".")
    read = lambda s: base64.urlsafe_b64decode(s + "=" * (-len(s) % 4))
    assert json.loads(read(claims)) == {"iss": "a@b", "scope": N.DOCS_SCOPE, "aud": N.GOOGLE_TOKEN, "iat": 1000, "exp": 4600}
    opened = pow(int.from_bytes(read(signature), "big"), e, n).to_bytes(128, "big")
    assert opened.endswith(hashlib.sha256(f"{head}.{claims}".encode()).digest()) and opened.startswith(b"\x00\x01\xff")


def test_every_channel_is_sent(spark):
    from tidemark.plans.queries import plain_alerts
    from tidemark.sinks import payloads

    rows = payloads.payloads(plain_alerts(spark, "/root/testdata/sf0.001").limit(1)).collect()
    url = {"url": "https://h.example"}
    options = {
        **dict.fromkeys(("slack", "discord", "teams", "googlechat", "webhook"), url), "telegram": {"token": "T", "chat_id": 5}, "pagerduty": {"routing_key": "R"}, "notion": {"token": "N", "database_id": "B", "names": {"Agent": "Who"}},
        "reddit": {"client_id": "c", "client_secret": "s", "username": "u", "password": "p", "subreddit": "r"}, "x": {"bearer": "b"}, "googlesheets": {"spreadsheet_id": "S", "range": "A B", "access_token": "a"}, "googledocs": {"document_id": "D", "access_token": "a"},
    }
    for r in rows:
        if r.channel == "email":
            continue
        net = Net(*([(200, '{"access_token": "t"}')] if r.channel == "reddit" else []))
        N.Sender(options, net)(r.channel, r.alert_id, r.payload)
        assert net.asked[-1][0] == "POST"
        if r.channel == "notion":
            assert "Who" in json.loads(net.asked[0][3])["properties"]
        if r.channel == "telegram":
            assert json.loads(net.asked[0][3])["chat_id"] == 5 and net.asked[0][1].endswith("/botT/sendMessage")
        with pytest.raises(N.SendError, match="HTTP 500"):
            N.Sender(options, Net(*[(500, "x" * 999)] * 2) if r.channel != "reddit" else Net((500, "")))(r.channel, r.alert_id, r.payload)
    with pytest.raises(N.SendError, match="no options"):
        N.Sender({})("slack", "1", "{}")
