from tillroll.operators import users as U
from tillroll.sources import users as US
from conftest import SF0001


def test_users_snapshot_has_no_secret_and_roles(spark):
    u = US.users(spark, SF0001)
    assert set(u.columns) == {"id", "name", "email", "role", "is_active", "created_at"}
    assert {r.role for r in u.select("role").distinct().collect()} <= {"customer", "seller", "marketer", "admin"}


def test_search_and_roles(spark):
    u = US.users(spark, SF0001)
    hits = U.user_search(u, "CUSTOMER#00000001", "all").collect()
    assert hits and all("customer#00000001" in h.name.lower() for h in hits)
    roles = {r.role: r.users for r in U.user_roles(spark, u).collect()}
    assert sum(roles.values()) == u.count() and set(roles) >= {"customer", "seller", "marketer", "admin"}


def accounts(spark, rows):
    existing = spark.createDataFrame([(1, "Ann", "ann@x.org", "customer", True, None)],
                                     "id long, name string, email string, role string, is_active boolean, created_at timestamp")
    req = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "arrival long, request_id string, name string, email string, role string")
    return {r.request_id: r.status for r in U.check_new_accounts(req, existing).collect()}


def test_only_valid_requests_claim_an_address(spark):
    assert accounts(spark, [("r1", "Bob", "b@x.org", "boss"), ("r2", "Bob", "b@x.org", "seller"), ("r3", "Bo", "b@x.org", "seller")]) == {
        "r1": "invalid_role", "r2": "accepted", "r3": "duplicate_email"}


def test_first_means_first_to_arrive(spark):
    assert accounts(spark, [("r9", "Dee", "d@x.org", "seller"), ("r10", "Dee", "d@x.org", "seller")]) == {"r9": "accepted", "r10": "duplicate_email"}


def test_address_is_checked_before_the_role(spark):
    assert accounts(spark, [("r1", "Ann", "ann@x.org", "boss"), ("r2", "Cy", "c@x.org", "seller"), ("r3", "Cy", "c@x.org", "boss"), ("r4", "Cy", "d@x.org", None)]) == {
        "r1": "duplicate_email", "r2": "accepted", "r3": "duplicate_email", "r4": "invalid_role"}


def test_addresses_are_compared_exactly_and_blanks_are_missing(spark):
    assert accounts(spark, [("r1", "Ann", "ANN@x.org", "customer"), ("r2", "", "e@x.org", "seller"), ("r3", "Eve", None, "seller"), ("r4", "Eve", " ", "seller")]) == {
        "r1": "accepted", "r2": "missing_fields", "r3": "missing_fields", "r4": "missing_fields"}
