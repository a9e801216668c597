from lorequarry.operators import federation as f

PAYMENT = '''from fastapi import APIRouter
@router.post("/api/payments")
def create_payment(payload): ...
@router.post("/api/payments/{payment_id}/refund")
def refund(payment_id): ...
    def charge(self, order):
        self.bus.publish("payment.captured", order)
'''
ORDER = '''import requests
        return requests.post("/api/payments", json=order)
        return requests.put(f"/api/payments/{order_id}/refund")
        return requests.post("https://host/api/tracking/register", json=order)
        self.bus.subscribe("payment.captured", self.on_captured)
'''
SHIPPING = 'from fastapi import APIRouter\n@router.post("/api/shipping/quote")\n'


def workspace(spark):
    return f.surfaces(spark.createDataFrame([("payment", PAYMENT), ("order", ORDER), ("shipping", SHIPPING), ("empty", None)], "project string, text string"))


def test_surfaces_and_states(spark):
    items = workspace(spark)
    got = {(r.project, r.kind, r.normalized): (r.state, r.provider, r.confidence, r.relation, r.detail) for r in f.link(items).collect()}
    assert got == {
        ("order", "http", "POST /api/payments"): ("linked", "payment", 0.95, "consumes", None),
        ("order", "http", "PUT /api/payments/{}/refund"): ("divergent", "payment", None, None, "POST /api/payments/{}/refund"),
        ("order", "http", "POST /api/tracking/register"): ("unresolved", None, None, None, None),
        ("order", "event", "payment.captured"): ("linked", "payment", 0.8, "subscribes", None),
        ("order", "package", "requests"): ("external", None, None, None, None),
        ("payment", "package", "fastapi"): ("external", None, None, None, None),
        ("shipping", "package", "fastapi"): ("external", None, None, None, None),
    }
    assert {r.normalized for r in items.where("direction = 'provides' AND kind = 'http'").collect()} == {"POST /api/payments", "POST /api/payments/{}/refund", "POST /api/shipping/quote"}
    assert {r.state for r in f.link(items, 0.97).where("provider IS NOT NULL AND confidence IS NOT NULL").collect()} == {"suggestion"}


def test_own_contracts_ties_and_many_providers(spark):
    rows = [(f"p{k:03d}", "http", "provides", "GET /health", 0.5, False) for k in range(300)] + [("p000", "http", "consumes", "GET /health", 0.5, None), ("p000", "http", "consumes", "GET /health", 0.4, None)]
    rows += [("z", "http", "provides", "GET /own", 0.9, True), ("z", "http", "consumes", "GET /own", 0.9, True), ("y", "http", "consumes", "GET /own", 0.9, None), (None, "http", "provides", "GET /x", 1.0, None), ("y", "event", "consumes", None, 1.0, None)]
    items = spark.createDataFrame(rows, "project string, kind string, direction string, normalized string, confidence double, contract boolean")
    got = sorted((r.project, r.normalized, r.state, r.provider, r.confidence, r.evidence) for r in f.link(items).collect())
    assert got == [("p000", "GET /health", "linked", "p001", 0.95, "method+path"), ("y", "GET /own", "linked", "z", 1.0, "contract"), ("z", "GET /own", "unresolved", None, None, None)]
    assert f.link(items.limit(0)).count() == 0


def test_contract_search(spark):
    got = f.contract_search(workspace(spark), spark.createDataFrame([(1, "refund payments now"), (2, "??"), (3, None)], "query_id long, text string"))
    best = got.where("query_id = 1").orderBy(f.F.desc("score"), "normalized").first()
    assert (best.normalized, best.score) == ("POST /api/payments/{}/refund", round(2 / 3 * 0.85, 6)) and {r.query_id for r in got.collect()} == {1}
