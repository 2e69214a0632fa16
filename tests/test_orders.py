import pytest

from checks import derive
from fabtrace.operators import orders
from fabtrace.sources.payload import orders_from_payload, payload_errors
from fabtrace.sources.schemas import ORDER_COLUMNS
from tests.helpers import rows_of


@pytest.fixture(scope="module")
def board(spark):
    rows = [
        ("1", "DEVT", "Confirmed", "VA1"),
        ("2", "PROD", "Done", "va22"),
        ("3", None, "Done", None),
        ("4", "DEVT", None, "XX.3"),
    ]
    df = spark.createDataFrame(rows, "febesOrderId string, owner string, orderStatus string, lotNumber string")
    return orders.board(df)


def ids(df):
    return sorted(r["External Order"] for r in df.collect())


def test_board_has_the_known_columns_present(board):
    assert board.columns == ["External Order", "Owner", "Order Status", "Lot Number"]
    assert len(ORDER_COLUMNS) == 21


def test_owners(board):
    assert ids(orders.of_owners(board)) == ["1", "4"]
    assert ids(orders.of_owners(board.where("Owner IS NULL OR Owner != 'DEVT'"))) == ["2"]
    assert ids(orders.of_owners(board, [])) == ["1", "2", "3", "4"]
    assert ids(orders.of_owners(board, ["PROD"])) == ["2"]
    assert [r[0] for r in orders.owners(board).collect()] == ["DEVT", "PROD"]


def test_search(board):
    assert ids(orders.search_lots(board, "  ")) == ["1", "2", "3", "4"]
    assert ids(orders.search_lots(board, "va")) == ["1", "2"]
    assert ids(orders.search_lots(board, "x.3")) == ["4"]
    assert ids(orders.search_lots(board, "a.", literal=True)) == []
    # Upper-casing turns the digit class into its complement, as in the source.
    assert ids(orders.search_lots(board, r"A\d")) == []


def test_facet_rules(board):
    assert ids(orders.of_facets(board, {"Owner": None})) == ["1", "2", "3", "4"]
    assert ids(orders.of_facets(board, {"Owner": ["DEVT", "PROD"]})) == ["1", "2", "3", "4"]
    assert ids(orders.of_facets(board, {"Owner": []})) == []
    assert ids(orders.of_facets(board, {"Owner": ["DEVT", "zzz"]})) == ["1", "4"]
    assert ids(orders.of_facets(board, {"Owner": ["DEVT", "zzz", "PROD"]})) == ["1", "2", "3", "4"]
    assert ids(orders.of_facets(board, {})) == ["1", "2", "3", "4"]
    assert ids(orders.of_facets(board, {"Owner": ["DEVT"], "Order Status": ["Confirmed"]})) == ["1"]
    # Every option is counted on the board given, not on what earlier facets left of it.
    assert ids(orders.of_facets(board, {"Owner": ["DEVT"], "Order Status": ["Done"]})) == []


def test_facets(board):
    got = [tuple(r) for r in orders.facets(board, ["Owner", "Order Status"]).collect()]
    assert got == [
        ("Order Status", "Confirmed"),
        ("Order Status", "Done"),
        ("Owner", "DEVT"),
        ("Owner", "PROD"),
    ]
    assert orders.search_options(orders.facets(board), "DEV").count() == 1


def test_tiles(board):
    assert tuple(orders.status_tiles(board).first()) == (4, 0, 1, 2, 0)
    assert rows_of(orders.status_counts(board)) == {("Confirmed", 1): 1, ("Done", 2): 1}


def test_highlight_of_unknown_status(board):
    got = {r["External Order"]: (r["highlight"], r["Owner"]) for r in orders.cells(board).collect()}
    assert got == {"1": (True, "DEVT"), "2": (False, "PROD"), "3": (False, "—"), "4": (False, "DEVT")}


def test_payloads(spark):
    rows = [
        (1, '{"priorityOrders":[{"owner":"A","deltaCurrentToPlan":-1.5,"extra":1},{"owner":"B"}]}'),
        (2, '{"priorityOrders":[]}'),
        (3, '{"message":"x","code":1}'),
        (4, "not json"),
        (5, '{"priorityOrders":[{"deltaCurrentToPlan":"1.5"},{"deltaCurrentToPlan":"n/a"}]}'),
        (6, '{"priorityOrders":{"owner":"A"}}'),
        (7, '{"priorityOrders":null}'),
        (8, '{"priorityOrders":[{"owner":"A"}'),
    ]
    df = spark.createDataFrame(rows, "payload_id int, value string")
    got = orders_from_payload(df)
    assert len(got.columns) == 2 + 21
    assert rows_of(got, "payload_id", "pos", "owner", "deltaCurrentToPlan") == {(1, 0, "A", "-1.5"): 1, (1, 1, "B", None): 1, (5, 0, None, "1.5"): 1, (5, 1, None, "n/a"): 1}
    bad = {r["payload_id"]: r["keys_found"] for r in payload_errors(df).collect()}
    assert bad == {3: ["message", "code"], 4: None, 6: ["priorityOrders"], 7: ["priorityOrders"], 8: None}


def test_known_counts(spark, small):
    board = orders.board(derive.priority_orders(spark, small), keep=["ordinal"])
    devt = orders.of_owners(board)
    assert tuple(orders.status_tiles(devt).first()) == (385, 64, 67, 58, 62)
    assert orders.search_lots(board, "0001").count() == 519
    assert board.where("`Delta Current To Plan` IS NOT NULL").count() == 1384
