"""The same results in DuckDB SQL, written from the definitions rather than from the plans."""

from __future__ import annotations

CTES: dict[str, str] = {}


def cte(name: str, sql: str) -> None:
    CTES[name] = sql


def lot(n: str) -> str:
    return f"('VA' || lpad(CAST({n} AS VARCHAR), 6, '0'))"


def op(n: str) -> str:
    return f"CAST(880 + ({n}) * 37 AS VARCHAR)"


def days(a: str, b: str) -> str:
    return f"(date_diff('microsecond', {a}, {b}) / 86400000000e0)"


def pick(n: str, values: list[str | None]) -> str:
    shown = ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values)
    return f"([{shown}])[CAST({n} AS INT) + 1]"


# ---- derived tables ----------------------------------------------------------------------

cte("ev", """
    SELECT event_id, ts, user_id, event_type, row_number() OVER w AS rn, lag(ts, 3) OVER w AS ts_back
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
cte("ev0", "SELECT *, CAST(floor((rn - 1) / 4e0) AS INT) % 12 + 1 AS step0 FROM ev")
cte("st", """
    SELECT *, CASE WHEN event_id % 9 = 0 AND step0 > 3 THEN step0 - 3 ELSE step0 END AS step FROM ev0""")
cte("part_groups", "SELECT max(p_partkey) // 72 + 1 AS groups FROM part")
CODE = """CASE event_type WHEN 'error' THEN 'HLLT' WHEN 'signup' THEN 'RLLT' WHEN 'purchase' THEN 'MVOU'
    WHEN 'click' THEN 'MVIN' ELSE 'COMM' END"""
cte("tx", f"""
    SELECT {lot('user_id')} AS lot, 'F' || CAST(user_id % (2 * groups) AS VARCHAR) AS facility,
      CASE WHEN event_id % 53 <> 0
           THEN 'R' || CAST((user_id + CAST(floor((rn - 1) / 48e0) AS INT)) % 3
                            + 3 * (user_id % (2 * groups) // 2) AS VARCHAR) END AS route,
      {op('step')} AS operation,
      CASE WHEN event_id % 97 = 0 THEN NULL WHEN event_type IN ('error', 'signup') THEN {op('step')}
           ELSE {op('step + 1')} END AS to_operation,
      ts AS time_stamp, date_trunc('day', ts) AS date_stamp,
      CASE WHEN event_id % 29 = 0 THEN 'Y' WHEN event_id % 31 = 0 THEN NULL ELSE 'N' END AS deleted_flag,
      {CODE} AS transcode, CAST(event_id % 25 AS INT) AS qty_out_1, 'WFR' AS unit_1,
      CASE WHEN event_id % 17 <> 0 THEN 'EQ' || CAST(event_id % 40 AS VARCHAR) END AS equipment,
      'W' || CAST(event_id % 5 AS VARCHAR) AS work_center, 'C' || CAST(event_id % 4 AS VARCHAR) AS cost_center,
      CASE WHEN event_id % 13 = 0 THEN 'Y' ELSE 'N' END AS rework_flag,
      CASE WHEN event_id % 10 = 0 THEN 'Y' END AS hot_lot_flag,
      CASE WHEN event_id % 14 = 0 THEN 'Y' END AS hot_oper_flag,
      CASE WHEN event_id % 19 = 0 THEN 'Y' END AS super_hot_flag,
      coalesce(ts_back, ts - INTERVAL 6 HOUR) AS entered,
      CASE event_id % 4 WHEN 0 THEN ts - INTERVAL 10 MINUTE WHEN 1 THEN ts - INTERVAL 1 HOUR
           WHEN 2 THEN ts END AS moved_in,
      CASE WHEN event_id % 5 <> 0 THEN (event_id % 7) * 0.125e0 END AS due_cycle_time,
      (event_id % 3) * 0.0625e0 AS due_process_cycle_time,
      coalesce(CASE WHEN event_id % 6 <> 0 THEN 'S' || CAST(event_id % 8 AS VARCHAR) END,
               'M' || CAST(event_id % 3 AS VARCHAR)) AS sps
    FROM st, part_groups""")
cte("slot", """
    SELECT p_partkey % 72 AS k, p_partkey // 72 AS g, p_name, p_type, p_brand,
      CAST(floor(p_partkey % 72 / 6e0) AS INT) % 12 + 1 AS step FROM part""")
cte("ro", f"""
    SELECT 'F' || CAST(k % 2 + 2 * g AS VARCHAR) AS facility,
      'R' || CAST(CAST(floor(k / 2e0) AS INT) % 3 + 3 * g AS VARCHAR) AS route, {op('step')} AS operation,
      step * 10 AS seq, CASE WHEN k % 5 = 0 THEN TIMESTAMP '2024-01-20' ELSE TIMESTAMP '2024-12-31' END AS created,
      step * 0.03125e0 AS process_ct, (step % 4) * 0.0625e0 AS queue_ct,
      CASE WHEN k % 11 = 0 THEN 'Y' WHEN k % 7 = 0 THEN NULL ELSE 'N' END AS optional
    FROM slot""")
cte("oper", f"""
    SELECT 'F' || CAST(k % 2 + 2 * g AS VARCHAR) AS facility,
      {op('CASE WHEN k < 22 THEN k // 2 + 1 ELSE k // 2 + 2 END')} AS operation,
      coalesce(CASE WHEN k % 3 <> 0 THEN p_type || ' ' || p_brand END,
               CASE WHEN k % 9 <> 0 THEN p_name END) AS described,
      CASE WHEN k % 8 = 0 THEN NULL WHEN k % 4 = 1 THEN 'Y' ELSE 'N' END AS store
    FROM slot""")
cte("equip", """
    SELECT 'EQ' || CAST(s_suppkey AS VARCHAR) AS equipment, min(s_name) AS described
    FROM supplier GROUP BY ALL""")

# ---- route -------------------------------------------------------------------------------

cte("stepped", """
    SELECT t.lot, t.facility, t.route, t.time_stamp, t.operation, r.seq, r.route IS NULL AS unplanned,
      coalesce(r.route, 'n/a') AS planned_route
    FROM tx t LEFT JOIN ro r ON r.facility = t.facility AND r.route = t.route AND r.operation = t.operation
      AND r.created >= t.date_stamp
    WHERE t.operation <> t.to_operation""")
cte("neighbours", """
    SELECT *, lag(planned_route, 1, 'prev') OVER l AS route_before, lead(planned_route, 1, 'next') OVER l AS route_after,
      lag(seq) OVER r AS seq_before, lead(seq) OVER r AS seq_after,
      max(seq) OVER (PARTITION BY lot, route ORDER BY time_stamp ROWS UNBOUNDED PRECEDING) AS reached
    FROM stepped
    WINDOW l AS (PARTITION BY lot ORDER BY time_stamp), r AS (PARTITION BY lot, route ORDER BY time_stamp)""")
cte("bounds", """
    SELECT lot, facility, route, time_stamp, seq, reached,
      CASE WHEN planned_route <> route_before OR unplanned OR planned_route <> route_after
             OR seq > seq_after OR seq < seq_before THEN operation END AS operation
    FROM neighbours""")
cte("kept", """
    SELECT *, lag(coalesce(route, 'n/a'), 1, 'prev') OVER l AS route_before, lag(seq) OVER l AS seq_before,
      coalesce(lead(seq, 1, 9999) OVER r, seq) AS step_reached
    FROM bounds WHERE operation IS NOT NULL
    WINDOW l AS (PARTITION BY lot ORDER BY time_stamp), r AS (PARTITION BY lot, route ORDER BY time_stamp)""")
cte("begun", """
    SELECT *, lead(seq, 1, 99999) OVER r AS seq_after, lead(operation) OVER l AS operation_after,
      lead(time_stamp, 1, TIMESTAMP '2024-02-01 01:00:00') OVER l AS left_at
    FROM kept WHERE coalesce(route, 'n/a') <> route_before OR seq < seq_before
    WINDOW l AS (PARTITION BY lot ORDER BY time_stamp), r AS (PARTITION BY lot, route ORDER BY time_stamp)""")
cte("seg", """
    SELECT lot, facility, route, operation, time_stamp AS began, seq, reached, left_at,
      CASE WHEN seq_after < step_reached THEN step_reached ELSE seq_after END AS to_seq,
      CASE WHEN operation_after IS NULL THEN 99999 ELSE step_reached END AS visited_until
    FROM begun""")
cte("master", """
    SELECT s.lot, s.facility, s.route, coalesce(r.operation, s.operation) AS operation, o.store, r.seq,
      CASE WHEN r.seq > s.visited_until THEN 'Y' ELSE 'N' END AS off_route, coalesce(o.described, '??') AS described,
      CASE WHEN s.reached > r.seq THEN NULL ELSE r.queue_ct END AS queue_ct,
      CASE WHEN s.reached > r.seq THEN NULL ELSE round(r.process_ct + r.queue_ct, 3) END AS due_ct,
      s.began, s.left_at
    FROM seg s LEFT JOIN ro r ON r.facility = s.facility AND r.route = s.route AND r.seq >= s.seq AND r.seq < s.to_seq
    LEFT JOIN oper o ON o.facility = coalesce(r.facility, s.facility) AND o.operation = coalesce(r.operation, s.operation)
    WHERE coalesce(r.optional, 'N') = 'N'""")

# The same with versions of the plan: of those created on or after a day the first counts, in the
# plan of a segment the last one if there is none.
cte("ro_versions", """
    SELECT * REPLACE (CASE WHEN age = 0 THEN created ELSE TIMESTAMP '2024-01-20' - to_days(CAST(4 * age AS INT)) END AS created,
                      process_ct * (age + 1) AS process_ct, seq + age AS seq)
    FROM ro, (SELECT unnest([0, 1, 2]) AS age) WHERE age = 0 OR (seq / 10) % (age + 1) <> 0""")
cte("stepped_v", """
    SELECT t.lot, t.facility, t.route, t.time_stamp, t.operation, r.seq, r.route IS NULL AS unplanned,
      coalesce(r.route, 'n/a') AS planned_route
    FROM (SELECT row_number() OVER () AS id, * FROM tx WHERE operation <> to_operation) t
    LEFT JOIN ro_versions r ON r.facility = t.facility AND r.route = t.route AND r.operation = t.operation
      AND r.created >= t.date_stamp
    QUALIFY row_number() OVER (PARTITION BY t.id ORDER BY r.created, r.seq) = 1""")
for name, source, target in (("neighbours", "stepped", "neighbours_v"), ("bounds", "neighbours", "bounds_v"),
                             ("kept", "bounds", "kept_v"), ("begun", "kept", "begun_v"), ("seg", "begun", "seg_v")):
    cte(target, CTES[name].replace(f"FROM {source}", f"FROM {source}_v"))
cte("ro_of_segment", """
    SELECT s.lot, s.facility, s.route, s.began, r.* EXCLUDE (facility, route)
    FROM (SELECT DISTINCT lot, facility, route, began FROM seg_v) s
    JOIN ro_versions r ON r.facility = s.facility AND r.route = s.route
    QUALIFY row_number() OVER (PARTITION BY s.lot, s.facility, s.route, s.began, r.operation
      ORDER BY created < date_trunc('day', s.began),
        CASE WHEN created < date_trunc('day', s.began) THEN -epoch(created) ELSE epoch(created) END, seq) = 1""")
cte("master_v", """
    SELECT s.lot, s.facility, s.route, coalesce(r.operation, s.operation) AS operation, o.store, r.seq,
      CASE WHEN r.seq > s.visited_until THEN 'Y' ELSE 'N' END AS off_route, coalesce(o.described, '??') AS described,
      CASE WHEN s.reached > r.seq THEN NULL ELSE r.queue_ct END AS queue_ct,
      CASE WHEN s.reached > r.seq THEN NULL ELSE round(r.process_ct + r.queue_ct, 3) END AS due_ct,
      s.began, s.left_at
    FROM seg_v s LEFT JOIN ro_of_segment r ON r.lot = s.lot AND r.facility = s.facility AND r.route = s.route
      AND r.began = s.began AND r.seq >= s.seq AND r.seq < s.to_seq
    LEFT JOIN oper o ON o.facility = s.facility AND o.operation = coalesce(r.operation, s.operation)
    WHERE coalesce(r.optional, 'N') = 'N'""")

# ---- holds and moves ---------------------------------------------------------------------

cte("hold_events", """
    SELECT lot, facility, route, operation, transcode, time_stamp,
      lag(time_stamp) OVER (PARTITION BY lot, facility, route, operation ORDER BY time_stamp, transcode) AS since
    FROM tx WHERE deleted_flag <> 'Y' AND transcode IN ('HLLT', 'RLLT')""")
cte("released", f"""
    SELECT lot, facility, route, operation, transcode, time_stamp AS released_at, {days('since', 'time_stamp')} AS held
    FROM hold_events WHERE transcode = 'RLLT'""")
cte("made0", """
    SELECT *, lag(time_stamp) OVER (PARTITION BY lot ORDER BY time_stamp) AS before
    FROM tx WHERE operation <> to_operation AND deleted_flag <> 'Y'""")
cte("made", f"""
    SELECT m.*, coalesce({days('coalesce(before, entered)', 'time_stamp')}, 0) AS cycle,
      coalesce({days('coalesce(before, entered)', 'moved_in')}, 0) AS wait,
      due_cycle_time - due_process_cycle_time AS due_wait, e.described AS equipment_description,
      (SELECT sum(h.held) FROM released h WHERE h.lot = m.lot AND h.facility = m.facility AND h.route = m.route
         AND h.operation = m.operation AND h.released_at BETWEEN m.entered AND m.time_stamp) AS held
    FROM made0 m LEFT JOIN equip e USING (equipment)""")

# ---- monitor -----------------------------------------------------------------------------

cte("visit0", f"""
    SELECT r.lot, r.operation, r.described, r.store, r.seq, r.began, r.facility, l.facility AS l_facility,
      coalesce(l.route, r.route, CASE WHEN r.store = 'Y' THEN 'store' ELSE r.described END) AS route,
      l.route AS l_route, l.operation AS l_operation, l.time_stamp, l.to_operation, l.transcode, l.cost_center,
      l.work_center, l.qty_out_1, l.unit_1, l.equipment, l.equipment_description, l.sps, l.rework_flag,
      l.hot_lot_flag, l.hot_oper_flag, l.super_hot_flag,
      sum(coalesce(l.due_cycle_time, r.due_ct)) AS target, sum(l.cycle) AS actual, sum(l.wait) AS waited,
      sum(coalesce(l.due_wait, r.queue_ct)) AS target_wait, sum({days('l.entered', 'l.time_stamp')}) AS stayed,
      sum(l.held) AS held
    FROM master r LEFT JOIN made l ON l.lot = r.lot AND l.facility = r.facility AND l.operation = r.operation
      AND coalesce(l.route, 'n/a') = coalesce(r.route, 'n/a') AND l.time_stamp >= r.began AND l.time_stamp < r.left_at
    GROUP BY ALL""")
cte("visit", """
    SELECT lot AS LOT, operation AS OPERATION, described AS OPERATION_DESC, 'N' AS OPTIONAL_OPER_FLAG,
      coalesce(store, CASE WHEN l_operation < '1000' THEN 'Y' ELSE 'N' END) AS STORE_FLAG,
      round(target, 4) AS TARGET_CT, round(actual, 4) AS ACTUAL_CT,
      round(coalesce(round(target, 4), 0) - coalesce(round(actual, 4), 0), 4) AS DELAY,
      round(waited, 4) AS WAITTIME, round(target_wait, 4) AS TARGET_WAITTIME, time_stamp AS TRANS_TIME,
      round(CASE WHEN target = 0 THEN 1 ELSE stayed / target END, 4) AS FF_TO_TARGET, sps AS SPS_NUMBER,
      equipment AS EQUIPMENT, equipment_description AS EQUIPMENT_DESC,
      round(avg(actual) OVER (PARTITION BY lot, operation, l_facility, l_route, l_operation, sps), 4) AS RPT,
      qty_out_1 AS AMOUNT, unit_1 AS UNIT, rework_flag AS REWORK, coalesce(hot_lot_flag, 'N') AS HOT_LOT_FLAG,
      coalesce(hot_oper_flag, 'N') AS HOT_OPER_FLAG, coalesce(super_hot_flag, 'N') AS SUPER_HOT_FLAG,
      facility AS FACILITY, route AS ROUTE, transcode AS TRANSCODE, cost_center AS COST_CENTER,
      work_center AS WORK_CENTER, round(held * 24, 4) AS HOLD_TIME_HRS, seq
    FROM visit0""")
cte("monitor", """
    SELECT * FROM visit v WHERE ACTUAL_CT IS NOT NULL OR (LOT, OPERATION) NOT IN
      (SELECT (LOT, OPERATION) FROM visit WHERE ACTUAL_CT IS NOT NULL)""")
cte("summary", """
    SELECT LOT, OPERATION,
      first(OPERATION_DESC ORDER BY seq NULLS LAST, TRANS_TIME NULLS LAST, OPERATION_DESC) AS OPERATION_DESC,
      round(sum(DELAY), 4) AS SUM_DELAY, count(DELAY) AS COUNT
    FROM monitor GROUP BY LOT, OPERATION HAVING round(sum(DELAY), 4) <= -0.5""")

# ---- history -----------------------------------------------------------------------------

NOTE = "(' note;of ' || CAST(event_id AS VARCHAR) || ' ')"
cte("recorded", f"""
    SELECT event_id, {lot('user_id')} AS lot, {op('step')} AS operation, {CODE} AS transcode, ts,
      CASE WHEN event_id % 6 <> 0 THEN 'S' || CAST(event_id % 8 AS VARCHAR) END AS sps,
      CASE WHEN event_id % 17 <> 0 THEN 'EQ' || CAST(event_id % 40 AS VARCHAR) END AS equipment,
      CASE WHEN event_id % 7 <> 0 THEN 'OP' || CAST(event_id % 10 AS VARCHAR) END AS operator,
      ([NULL, '', '   ', 'a;b', {NOTE}])[event_id % 5 + 1] AS comment, event_id % 2 = 0 AS reserved,
      CASE WHEN event_id % 3 <> 0 THEN 'RM' || CAST(event_id % 9 AS VARCHAR) END AS machine,
      CASE WHEN event_id % 4 <> 0 THEN 'RO' || CAST(event_id % 11 AS VARCHAR) END AS reserver,
      (['025', '25.50', 'abc', NULL, '0.50', '100', '123456789012345678901234567890123456789012.00000000000120',
        '-0.000000000000001', '1.5e3'])[CAST(floor(event_id / 24e0) AS BIGINT) % 9 + 1] AS quantity,
      (['25', '25.5', '', NULL, '.5', '100', '123456789012345678901234567890123456789012.0000000000012',
        '-.000000000000001', '1500'])[CAST(floor(event_id / 24e0) AS BIGINT) % 9 + 1] AS quantity_shown,
      CASE WHEN event_id % 3 <> 1 THEN 'H' || CAST(event_id % 6 AS VARCHAR) END AS hold_code,
      ([NULL, '  ', 'held', repeat({NOTE}, 60)])[CAST(floor(event_id / 24e0) AS BIGINT) % 4 + 1] AS hold_comment
    FROM st""")
# Fixed values, as the texts are defined: code, text, followed by the operator, followed by the comment
cte("wording", """
    SELECT * FROM (VALUES ('MVIN', 'Lot moved in logged by ', true, true),
      ('MVOU', 'Lot moved out logged by ', true, true), ('TRST', 'Lot moved to/from store logged by ', true, true),
      ('SLTA', 'Lotattribute set logged by ', true, true), ('RLLT', 'Lot released logged by ', true, true),
      ('HLLT', 'Lot hold logged by ', true, true), ('COMM', 'Lot comment logged by', false, true),
      ('1RCL', 'Lot moved to entity logged by', false, true), ('EDC', 'Transaction logged logged by', false, true),
      ('JC', 'Transaction logged logged by', false, true), ('TASK', 'Transaction logged logged by', false, true),
      ('ALFG', 'Transaction logged logged by', false, true), ('EI', 'EI comment logged by', false, true),
      ('2PSO', 'SIP moved out logged by ', true, false), ('2PSI', 'SIP moved in logged by ', true, false),
      ('2CRT', 'Lot created by ', true, false), ('2SCR', 'Lot scrapped by ', true, false),
      ('2HLD', 'Lot set on HOLD by ', true, true), ('2HRL', 'Hold released by ', true, true)
    ) AS w(code, words, with_operator, with_comment)""")


def mes_select(source: str, literal: bool = False) -> str:
    who = "coalesce(r.operator, 'SYSTEM')"
    comment = "''" if literal else "CASE WHEN trim(r.comment) <> '' THEN chr(10) || r.comment ELSE '' END"
    hold = (
        "''" if literal
        else "CASE WHEN trim(r.hold_comment) <> '' THEN chr(10) || r.hold_comment ELSE '' END"
    )
    return f"""
    SELECT r.lot AS LOT, r.ts AS TRANS_TIMESTAMP, r.operation AS OPERATION, r.transcode AS TRANSACTION,
      r.sps AS UPS, r.equipment AS EQUIPMENT, r.operator AS OPERATOR_ID, r.comment AS COMMENTTEXT,
      CASE
        WHEN r.transcode = '2RSV' AND r.reserved THEN concat('LOT WAS RESERVED FOR ENTITY ',
          coalesce(r.machine, r.equipment), '   FROM OPERAT. ', coalesce(r.reserver, r.operator))
        WHEN r.transcode = '2RSV' THEN 'Reservation canceled.'
        WHEN r.transcode IN ('2SON', '2SIN') THEN concat(r.operator, ' Special Run ',
          CASE r.transcode WHEN '2SON' THEN 'END' ELSE 'START' END,
          CASE WHEN r.quantity IS NOT NULL THEN ' /Wafer: ' || r.quantity_shown END, ' /Entity: ' || r.equipment)
        WHEN r.transcode = '2SHL' THEN coalesce(nullif(trim(r.comment), ''), 'ALF Stop logged by ' || {who})
        WHEN r.transcode IN ('2HLD', '2HRL') THEN concat(w.words, {who},
          CASE WHEN r.transcode = '2HLD' THEN ' | Code: ' || r.hold_code END, {hold})
        WHEN w.code IS NOT NULL THEN concat(w.words, CASE WHEN w.with_operator THEN {who} END,
          CASE WHEN w.with_comment THEN {comment} END)
        ELSE coalesce(nullif(trim(r.comment), ''), '(' || r.transcode || ' by ' || {who} || ')')
      END AS TEXT
    FROM {source} r LEFT JOIN wording w ON w.code = r.transcode"""


def fallback_select(source: str) -> str:
    who = "coalesce(r.operator, 'SYSTEM')"
    cleaned = "replace(r.comment, ';', chr(20))"
    return f"""
    SELECT r.lot AS LOT, r.ts AS TRANS_TIMESTAMP, r.operation AS OPERATION, r.transcode AS TRANSACTION,
      r.sps AS UPS, r.equipment AS EQUIPMENT, r.operator AS OPERATOR_ID, {cleaned} AS COMMENTTEXT,
      CASE WHEN w.code IS NOT NULL THEN concat(w.words, CASE WHEN w.with_operator THEN {who} END,
             CASE WHEN trim(r.comment) <> '' THEN chr(10) || {cleaned} END)
           ELSE coalesce(nullif(trim({cleaned}), ''), '(' || r.transcode || ' by ' || {who} || ')') END AS TEXT
    FROM {source} r LEFT JOIN wording w ON w.code = r.transcode"""


MES_CODES = """['2RSV', '2SON', '2SIN', '2PSO', '2PSI', 'MVIN', 'MVOU', 'TRST', 'SLTA', 'COMM', 'RLLT', 'HLLT',
    '1RCL', 'ALFG', '2SHL', '2HLD', '2HRL', 'EI', 'EDC', 'JC', 'TASK', '2CRT', '2SCR', 'UNKN']"""
FALLBACK_CODES = """['MVOU', 'MVIN', 'RLLT', 'HLLT', '1RCL', 'TRST', 'SLTA', 'COMM', 'JC', 'EDC', 'TASK', '2HLD',
    '2HRL', 'UNKN']"""
cte("mes_coded", f"SELECT * REPLACE (({MES_CODES})[event_id % 24 + 1] AS transcode) FROM recorded")
cte("fallback_coded", f"SELECT * REPLACE (({FALLBACK_CODES})[event_id % 14 + 1] AS transcode) FROM recorded")
cte("merged", f"""
    SELECT 1 AS source, * FROM ({mes_select('(SELECT * FROM recorded WHERE event_id % 2 = 0)')})
    UNION ALL SELECT 2, * FROM ({fallback_select('(SELECT * FROM recorded WHERE event_id % 3 = 0)')})
    UNION ALL SELECT 3, * FROM ({fallback_select('(SELECT * FROM recorded WHERE event_id % 5 = 0)')})
    UNION ALL SELECT 4, * FROM ({fallback_select('recorded')})""")
cte("timeline", """
    SELECT * EXCLUDE (source) FROM merged
    QUALIFY row_number() OVER (PARTITION BY LOT, TRANS_TIMESTAMP, OPERATION, TRANSACTION ORDER BY source) = 1""")

# ---- orders ------------------------------------------------------------------------------

DAY = "CAST(CAST(o_orderdate AS DATE) AS VARCHAR)"
cte("po", f"""
    SELECT o_orderkey AS ordinal, 'EO' || CAST(o_orderkey AS VARCHAR) AS febesOrderId,
      {pick('o_custkey % 4', ['DEVT', 'PROD', 'QUAL', None])} AS owner,
      {pick('o_orderkey % 6', ['In Production', 'Confirmed', 'Done', 'Warning', 'Terminated', 'Parked'])} AS orderStatus,
      CAST(o_orderkey % 25 AS VARCHAR) AS orderQuantity, 'WFR' AS orderUnit,
      CASE o_orderkey % 3 WHEN 1 THEN '' WHEN 2 THEN 'rem ' || CAST(o_orderkey % 9 AS VARCHAR) END AS orderRemark,
      {pick('o_orderkey % 2', ['200', '300'])} AS waferSize,
      CASE WHEN o_orderkey % 7 <> 0 THEN {lot('o_custkey')} END AS lotNumber,
      'R' || CAST(o_orderkey % 11 AS VARCHAR) AS lotResponsible,
      CASE WHEN o_orderkey % 13 <> 0 THEN (o_orderkey % 401 - 200) * 0.03125e0 END AS deltaCurrentToPlan,
      'Q' || CAST(o_orderkey % 13 AS VARCHAR) AS requestor, 'U' || CAST(o_orderkey % 3 AS VARCHAR) AS lotPurpose,
      {pick('o_orderkey % 4', ['Hot', 'Rocket', 'Normal', 'Low'])} AS priority,
      'C' || CAST(o_orderkey % 5 AS VARCHAR) AS priorityCorridor,
      'F' || CAST(o_orderkey % 2 AS VARCHAR) AS currentFacility, {op('o_orderkey % 12 + 1')} AS currentOperation,
      {DAY} AS confirmedDeliveryDate, CASE WHEN o_orderkey % 10 <> 0 THEN {DAY} END AS currentDeliveryDate,
      'D' || CAST(o_orderkey % 5 AS VARCHAR) AS businessDivision,
      'P' || CAST(o_orderkey % 8 AS VARCHAR) AS processGroup, o_orderpriority AS createUser
    FROM orders""")
# payload key and board column
BOARD = [
    ("febesOrderId", "External Order"), ("owner", "Owner"), ("orderStatus", "Order Status"),
    ("orderQuantity", "Start Quan."), ("orderUnit", "Order Unit"), ("orderRemark", "Order Rem."),
    ("waferSize", "Wafer Size"), ("lotNumber", "Lot Number"), ("lotResponsible", "Lot Responsible"),
    ("deltaCurrentToPlan", "Delta Current To Plan"), ("requestor", "Requestor"),
    ("lotPurpose", "Lot Purpose"), ("priority", "Priority"), ("priorityCorridor", "Priority Corridor"),
    ("currentFacility", "Current Facility"), ("currentOperation", "Current Op."),
    ("confirmedDeliveryDate", "Confirmed Delivery"), ("currentDeliveryDate", "Current Delivery"),
    ("businessDivision", "Division"), ("processGroup", "Process Group"), ("createUser", "Create User"),
]
cte("board", "SELECT ordinal, " + ", ".join(f'{k} AS "{v}"' for k, v in BOARD) + " FROM po")
cte("devt", """SELECT * FROM board WHERE "Owner" = 'DEVT'""")
cte("paged", """
    SELECT *, row_number() OVER (ORDER BY ordinal) AS row_number,
      CAST((row_number() OVER (ORDER BY ordinal) - 1) // 200 + 1 AS INT) AS page FROM devt""")
cte("options", " UNION ".join(
    f"SELECT '{v}' AS facet, CAST({k} AS VARCHAR) AS value FROM po WHERE {k} IS NOT NULL" for k, v in BOARD
))
# The payloads' orders; other shapes stand in some places, and some delays are text.
OTHER_SHAPES = "ordinal % 50 IN (7, 8, 9, 10, 11)"
cte("landed", f"""
    SELECT * REPLACE (CASE WHEN ordinal % 17 = 3 THEN 'n/a' ELSE CAST(deltaCurrentToPlan AS VARCHAR) END
                      AS deltaCurrentToPlan) RENAME (ordinal AS payload_id), 0 AS pos
    FROM po WHERE NOT ({OTHER_SHAPES})
    UNION ALL BY NAME SELECT ordinal AS payload_id, 1 AS pos, febesOrderId || 'B' AS febesOrderId, owner, lotNumber
    FROM po WHERE NOT ({OTHER_SHAPES})""")
cte("landed_board", "SELECT payload_id * 2 + pos AS ordinal, " + ", ".join(f'{k} AS "{v}"' for k, v in BOARD) + " FROM landed")
DELTA = '"Delta Current To Plan"'
NUMBER = f"TRY_CAST({DELTA} AS DOUBLE)"
DELTA_TEXT = f"""CASE WHEN {DELTA} IS NULL THEN '—' WHEN {NUMBER} = 0 THEN '0.0000'
    WHEN {NUMBER} IS NOT NULL THEN printf('%.4f', {NUMBER}) ELSE CAST({DELTA} AS VARCHAR) END"""
DELTA_SIGN = f"""CASE WHEN {DELTA} IS NULL THEN '' WHEN {NUMBER} < 0 THEN 'negative' WHEN {NUMBER} > 0 THEN 'positive'
    WHEN {NUMBER} = 0 THEN 'zero' ELSE 'text' END"""


def cells(empty: str) -> str:
    return ", ".join(
        f'{DELTA_TEXT} AS "{v}"'
        if k == "deltaCurrentToPlan"
        else f"""CASE WHEN "{v}" IS NULL OR {empty.format(f'"{v}"')} THEN '—' ELSE "{v}" END AS "{v}" """
        for k, v in BOARD
    )


CLASSES = f"""CASE WHEN "Order Status" IN ('In Production', 'Confirmed', 'Warning', 'Done', 'Terminated')
       THEN replace(lower("Order Status"), ' ', '-') ELSE 'x' END AS status_class,
  CASE WHEN "Priority" IN ('Hot', 'Rocket', 'Normal') THEN lower("Priority") ELSE 'x' END AS priority_class,
  {DELTA_SIGN} AS delta_sign, coalesce("Order Status" = 'Confirmed', false) AS highlight"""

# ---- annotations -------------------------------------------------------------------------

NAMES = '"LOT NUMBER", "OPERATION", "DESCRIPTION", "ISSUE", "REMARKS"'
KEY = f"{lot('doc_id % 150')} AS \"LOT NUMBER\", {op('doc_id % 12 + 1')} AS \"OPERATION\""
cte("notes", f"""
    SELECT {KEY}, text AS "DESCRIPTION", {pick('doc_id % 4', ['Disposition', 'Delay load', '', ''])} AS "ISSUE",
      lang AS "REMARKS" FROM documents""")
cte("entered", f"""
    SELECT {KEY}, 'quality ' || CAST(quality AS VARCHAR) AS "DESCRIPTION",
      CASE WHEN toxic = 1 THEN '' ELSE 'Batching' END AS "ISSUE", '' AS "REMARKS" FROM labels""")
cte("grouped", """SELECT *, coalesce(nullif("ISSUE", ''), 'Uncategorized') AS "CATEGORY" FROM notes""")

# ---- logs --------------------------------------------------------------------------------

MARKS = [
    "", "IllegalOptionException", "customization-profiles",
    "another process has locked a portion of the file", "ConfigurationAreaChecker",
    "EXCEPTION_ACCESS_VIOLATION", "DB Connection no longer available", "created an empty data table",
    "ConfigurationAreaChecker after EXCEPTION_ACCESS_VIOLATION",
]
cte("logs", f"""
    SELECT text || chr(10) || {pick('doc_id % 9', MARKS)} AS log, doc_id % 5 = 0 AS broke, doc_id % 4 <> 0 AS wrote
    FROM documents""")
CUSTOMER_TEXT = (
    "concat("
    + ", ".join(
        f"coalesce(CAST(length(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"
        for c in ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
    )
    + ")"
)
ORDER_TYPES = [
    ("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"), ("o_totalprice", "double"),
    ("o_orderdate", "timestamp_ntz"), ("o_orderpriority", "string"),
]

MONITOR = """LOT, OPERATION, OPERATION_DESC, OPTIONAL_OPER_FLAG, STORE_FLAG, TARGET_CT, ACTUAL_CT, DELAY, WAITTIME,
    TARGET_WAITTIME, TRANS_TIME, FF_TO_TARGET, SPS_NUMBER, EQUIPMENT, EQUIPMENT_DESC, RPT, AMOUNT, UNIT, REWORK,
    HOT_LOT_FLAG, HOT_OPER_FLAG, SUPER_HOT_FLAG, FACILITY, ROUTE, TRANSCODE, COST_CENTER, WORK_CENTER, HOLD_TIME_HRS"""
TIMELINE = "LOT, TRANS_TIMESTAMP, TRANSACTION, OPERATION, UPS, EQUIPMENT, OPERATOR_ID, TEXT"

FINAL: dict[str, str] = {
    "actual_cycle_time": """
        SELECT lot, operation, count(*) AS moves, round(sum(cycle), 4) AS actual_ct, round(sum(wait), 4) AS waittime
        FROM made GROUP BY lot, operation""",
    "boundary_moves": """
        SELECT lot, facility, route, time_stamp, operation, seq AS operation_sequence_number,
          reached AS loop_back_indicator FROM bounds""",
    "route_segments": """
        SELECT lot, facility, route, operation, began AS route_order_seq, seq AS operation_sequence_number,
          reached AS loop_back_indicator, to_seq AS to_operation_sequence_number, visited_until,
          left_at AS route_leave_time_stamp FROM seg""",
    "route_master": """
        SELECT lot, facility, route, operation, store AS store_flag, seq AS operation_sequence_number,
          off_route AS is_off_route, described AS operation_desc, queue_ct AS queue_cycle_time, due_ct,
          began AS route_order_seq, left_at AS route_leave_time_stamp, 'N' AS optional_oper_flag FROM master""",
    "boundary_moves_one_version": """
        SELECT lot, facility, route, time_stamp, operation, seq AS operation_sequence_number,
          reached AS loop_back_indicator FROM bounds_v""",
    "route_master_one_version": """
        SELECT lot, facility, route, operation, store AS store_flag, seq AS operation_sequence_number,
          off_route AS is_off_route, described AS operation_desc, queue_ct AS queue_cycle_time, due_ct,
          began AS route_order_seq, left_at AS route_leave_time_stamp, 'N' AS optional_oper_flag FROM master_v""",
    "hold_history": """
        SELECT lot, facility, route, operation, transcode, released_at AS rllt_time_stamp, held AS actual_holdtime
        FROM released""",
    "hold_time_in_operation": """
        SELECT lot, operation, entered AS enter_op_ts, time_stamp AS trans_time, round(held, 6) AS holdtime
        FROM made WHERE held IS NOT NULL""",
    "valid_moves": """
        SELECT lot, facility, route, operation, to_operation, time_stamp AS trans_time, transcode, qty_out_1, unit_1,
          equipment, equipment_description, work_center, cost_center, rework_flag, hot_lot_flag, hot_oper_flag,
          super_hot_flag, entered AS enter_op_ts, due_cycle_time, round(due_wait, 6) AS due_wait_time,
          round(cycle, 6) AS cycle_time, round(wait, 6) AS wt, sps AS sps_number,
          round(held, 6) AS actual_holdtime FROM made""",
    "lot_monitor": f"SELECT {MONITOR} FROM monitor",
    "lot_monitor_ordered": f"SELECT {MONITOR} FROM monitor ORDER BY LOT, seq NULLS LAST, TRANS_TIME NULLS LAST",
    "lot_monitor_basic": """
        SELECT LOT, OPERATION, OPERATION_DESC AS "Operation_Desc", OPTIONAL_OPER_FLAG AS "Optional_Oper_Flag",
          STORE_FLAG AS "Store_Oper_Flag", TARGET_CT AS "Target_Ct", ACTUAL_CT AS "Actual_Ct", WAITTIME,
          TARGET_WAITTIME AS "Target_Waittime", TRANS_TIME AS "Time_Stamp", FF_TO_TARGET AS "FF_To_TargetFF",
          SPS_NUMBER AS "Sps_Number", EQUIPMENT, EQUIPMENT_DESC AS "Equipment_Description", RPT, AMOUNT, UNIT, REWORK,
          HOT_LOT_FLAG AS "Hot_Lot_Flag", HOT_OPER_FLAG AS "Hot_Oper_Flag", SUPER_HOT_FLAG AS "Super_Hot_Flag",
          FACILITY, ROUTE, TRANSCODE, COST_CENTER AS "Cost_Center", WORK_CENTER AS "Work_Center"
        FROM visit ORDER BY LOT, TRANS_TIME NULLS LAST""",
    "lot_monitor_for_lots": f"""
        SELECT {MONITOR} FROM monitor WHERE LOT IN
          (SELECT {lot('c_custkey * 2')} FROM customer UNION SELECT {lot('c_custkey * 3')} FROM customer)""",
    "lot_monitor_one_lot": f"SELECT {MONITOR} FROM monitor WHERE LOT = 'VA000007'",
    "ff_to_target": "SELECT LOT, OPERATION, TRANS_TIME, TARGET_CT, FF_TO_TARGET FROM visit",
    "rpt_by_operation": """
        SELECT DISTINCT LOT, FACILITY, ROUTE, OPERATION, SPS_NUMBER, RPT FROM visit WHERE RPT IS NOT NULL""",
    "delay_summary": "SELECT * FROM summary",
    "top_delays": "SELECT * FROM summary ORDER BY SUM_DELAY, LOT, OPERATION LIMIT 20",
    "jump_list": """
        SELECT LOT, OPERATION, SUM_DELAY, OPERATION || ' — ' || OPERATION_DESC AS LABEL FROM summary
        ORDER BY LOT, SUM_DELAY, OPERATION""",
    "lot_kpis": """
        SELECT LOT, count(*) AS TOTAL_OPERATIONS,
          first(ROUTE ORDER BY seq NULLS LAST, TRANS_TIME NULLS LAST, ROUTE) FILTER (WHERE ROUTE IS NOT NULL) AS ROUTE,
          first(FACILITY ORDER BY seq NULLS LAST, TRANS_TIME NULLS LAST) FILTER (WHERE FACILITY IS NOT NULL) AS FACILITY,
          round(sum(ACTUAL_CT), 4) AS TOTAL_ACTUAL_CT FROM monitor GROUP BY LOT""",
    "history_text_mes": mes_select("mes_coded"),
    "history_text_mes_literal": mes_select("mes_coded", literal=True),
    "history_text_fallback": fallback_select("fallback_coded"),
    "history_unified": f"""
        SELECT {TIMELINE} FROM timeline ORDER BY LOT, TRANS_TIMESTAMP DESC NULLS LAST, OPERATION, TRANSACTION""",
    "history_text_times": """
        SELECT DISTINCT lot AS LOT, CASE WHEN event_id % 11 <> 0 THEN ts END AS TRANS_TIMESTAMP, operation AS OPERATION,
          transcode AS TRANSACTION FROM recorded""",
    "delayed_history": f"""
        SELECT * FROM timeline t WHERE (LOT, OPERATION) IN (SELECT (LOT, OPERATION) FROM summary)
          OR ((LOT, OPERATION) IN (SELECT ({lot('doc_id % 150')}, {op('doc_id % 12 + 1')}) FROM labels)
              AND LOT NOT IN (SELECT LOT FROM summary))""",
    "history_one_operation": "SELECT * FROM timeline WHERE OPERATION = '991'",
    "orders_from_payload": "SELECT * FROM landed",
    "payload_errors": f"""
        SELECT ordinal AS payload_id, CASE ordinal % 50 WHEN 7 THEN 'message,code' WHEN 9 THEN 'priorityOrders'
          WHEN 10 THEN 'priorityOrders,owner' END AS keys_found
        FROM po WHERE {OTHER_SHAPES}""",
    "order_board": f"""SELECT ordinal, {cells("{0} = ''")}, {CLASSES} FROM landed_board""",
    "order_board_zero_as_none": f"""
        SELECT ordinal, {cells("{0} = '' OR coalesce(TRY_CAST({0} AS DOUBLE) = 0, false)")}, {CLASSES} FROM board""",
    "orders_search_literal": """SELECT * FROM board WHERE contains(upper("Lot Number"), 'VA0001')""",
    "orders_by_parameter": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'",
    "order_owners": """SELECT DISTINCT "Owner" FROM board WHERE "Owner" IS NOT NULL ORDER BY 1""",
    "orders_by_owner": "SELECT * FROM devt",
    "orders_search": """SELECT * FROM board WHERE regexp_matches(upper("Lot Number"), 'VA0+1[02]')""",
    "orders_faceted": """
        SELECT * FROM board WHERE "Order Status" IN ('Confirmed', 'Warning') AND "Owner" IN ('DEVT', 'PROD')""",
    "order_facets": "SELECT * FROM options ORDER BY facet, value",
    "facet_option_search": "SELECT * FROM options WHERE contains(lower(value), 'r1')",
    "order_status_kpi": """
        SELECT count(*) AS "Total Orders", count(*) FILTER (WHERE "Order Status" = 'In Production') AS "In Production",
          count(*) FILTER (WHERE "Order Status" = 'Confirmed') AS "Confirmed",
          count(*) FILTER (WHERE "Order Status" = 'Done') AS "Done",
          count(*) FILTER (WHERE "Order Status" = 'Warning') AS "Warning" FROM devt""",
    "order_status_counts": 'SELECT "Order Status", count(*) AS orders FROM board GROUP BY 1',
    "order_pages": "SELECT * FROM paged",
    "order_page": "SELECT * FROM paged WHERE page = 2 ORDER BY row_number",
    "order_pages_by_text": """
        SELECT *, row_number() OVER w AS row_number, CAST((row_number() OVER w - 1) // 200 + 1 AS INT) AS page
        FROM board WINDOW w AS (ORDER BY "Current Delivery" DESC NULLS LAST, "External Order")""",
    "history_pages": f"""
        SELECT {TIMELINE}, row_number() OVER w AS row_number, CAST((row_number() OVER w - 1) // 200 + 1 AS INT) AS page
        FROM timeline WINDOW w AS (ORDER BY TRANS_TIMESTAMP DESC NULLS LAST, LOT, OPERATION, TRANSACTION)""",
    "order_page_deep": """
        SELECT *, 5 AS page FROM (SELECT *, row_number() OVER (ORDER BY "Priority" NULLS LAST,
          "Delta Current To Plan" NULLS LAST, ordinal) AS row_number FROM board)
        WHERE row_number BETWEEN 801 AND 1000 ORDER BY row_number""",
    "order_page_after": """
        SELECT * FROM board ORDER BY "Lot Number" NULLS LAST, ordinal LIMIT 200 OFFSET 400""",
    "order_page_info": """
        SELECT count(*) AS total, CAST(greatest(1, ceil(count(*) / 200e0)) AS INT) AS pages, 2 AS page,
          201 AS showing_from, least(400, count(*)) AS showing_to FROM devt""",
    "delta_format": f"""
        SELECT ordinal, CASE WHEN {DELTA} IS NULL THEN '—' WHEN {NUMBER} = floor({NUMBER})
            THEN CAST(CAST({NUMBER} AS BIGINT) AS VARCHAR) WHEN {NUMBER} IS NOT NULL THEN printf('%.1f', {NUMBER})
            ELSE {DELTA} END AS short_text,
          {DELTA_TEXT} AS delta_text, {DELTA_SIGN} AS delta_sign FROM landed_board""",
    "annotations_clean": f"""
        SELECT {lot('doc_id % 150')} AS "LOT NUMBER", CAST(doc_id % 12 + 1 AS VARCHAR) AS "OPERATION",
          text AS "DESCRIPTION", CASE WHEN doc_id % 4 = 2 THEN 'Batching' ELSE '' END AS "ISSUE", '' AS "REMARKS"
        FROM documents""",
    "annotations_read": f"""
        SELECT {lot('doc_id % 150')} AS "LOT NUMBER", CAST(doc_id % 12 + 1 AS VARCHAR) AS "OPERATION",
          text AS "DESCRIPTION", CASE WHEN doc_id % 4 = 2 THEN 'Batching' ELSE '' END AS "ISSUE", '' AS "REMARKS"
        FROM documents""",
    "annotations_two_writers": f"""
        SELECT {NAMES} FROM notes WHERE ("LOT NUMBER", "OPERATION") NOT IN
          (SELECT ("LOT NUMBER", "OPERATION") FROM entered)
        UNION ALL SELECT {NAMES} FROM (SELECT * REPLACE ('0' AS "OPERATION") FROM entered)""",
    "annotations_emptied": f"SELECT {NAMES} FROM entered",
    "annotation_categories": 'SELECT "CATEGORY", count(*) AS "RECORDS" FROM grouped GROUP BY 1 ORDER BY 1',
    "annotations_by_category": f"""
        SELECT "CATEGORY", {NAMES}, count(*) OVER (PARTITION BY "CATEGORY") AS "RECORDS" FROM grouped""",
    "annotations_of_category": f"""SELECT {NAMES} FROM grouped WHERE "CATEGORY" = 'Uncategorized'""",
    "annotations_append": f"SELECT {NAMES} FROM notes UNION ALL SELECT {NAMES} FROM entered",
    "annotations_lookup": f"""
        SELECT {NAMES} FROM notes WHERE ("LOT NUMBER", "OPERATION") IN
          (SELECT ("LOT NUMBER", "OPERATION") FROM entered)""",
    "annotations_delete": f"""
        SELECT {NAMES} FROM notes WHERE ("LOT NUMBER", "OPERATION") NOT IN
          (SELECT ("LOT NUMBER", "OPERATION") FROM entered)""",
    "lots_from_text": f"""
        SELECT c_custkey AS request_id, {lot('c_custkey * 2')} AS lot FROM customer
        UNION ALL SELECT c_custkey, {lot('c_custkey * 3')} FROM customer""",
    "workbook_merge": """
        SELECT 'VA000001' AS lot, 'a sheet name that is longer than a workbook allows' AS sheet,
          CAST(c_custkey AS VARCHAR) AS key, c_name AS name, c_mktsegment, NULL::VARCHAR AS s_nationkey FROM customer
        UNION ALL SELECT 'VA000002', 'a sheet name that is longer than a workbook allows',
          'S' || CAST(s_suppkey AS VARCHAR), s_name, NULL, CAST(s_nationkey AS VARCHAR) FROM supplier
        UNION ALL SELECT 'VA000002', 'Sheet1', CAST(n_nationkey AS VARCHAR), n_name, NULL, NULL FROM nation""",
    "workbook_read": """
        SELECT 'VA000002' AS lot, 'Sheet1' AS sheet, CAST(n_nationkey AS VARCHAR) AS key, n_name AS name FROM nation""",
    "workbook_read_wide": """
        SELECT 'VA000001' AS lot, 'a sheet name that is longer than a workbook allows' AS sheet,
          CAST(c_custkey AS VARCHAR) AS key, c_name AS name, c_mktsegment, NULL::VARCHAR AS s_nationkey FROM customer
        UNION ALL SELECT 'VA000002', 'a sheet name that is longer than a workbook allows',
          'S' || CAST(s_suppkey AS VARCHAR), s_name, NULL, CAST(s_nationkey AS VARCHAR) FROM supplier""",
    "workbook_catalogue": """
        SELECT * FROM (VALUES ('a sheet name that is longer than a workbook allows', 1, 'key'),
          ('a sheet name that is longer than a workbook allows', 2, 'name'),
          ('a sheet name that is longer than a workbook allows', 3, 'c_mktsegment'),
          ('a sheet name that is longer than a workbook allows', 4, 's_nationkey'),
          ('Sheet1', 1, 'key'), ('Sheet1', 2, 'name')) t(sheet, ordinal, column_name)""",
    "workbook_unreadable": "SELECT '{damaged ' || n_name AS record FROM nation",
    "table_profile_distinct": " UNION ALL ".join(
        f"SELECT {i} AS ordinal, '{c}' AS column_name, true AS near_exact" for i, (c, _) in enumerate(ORDER_TYPES, 1)
    ),
    "table_profile": " UNION ALL ".join(
        f"""SELECT {i} AS ordinal, '{c}' AS column_name, '{t}' AS data_type, count(*) AS row_count,
          count(*) - count({c}) AS null_count, CAST(min({c}) AS VARCHAR) AS min_value,
          CAST(max({c}) AS VARCHAR) AS max_value FROM orders"""
        for i, (c, t) in enumerate(ORDER_TYPES, 1)
    ),
    "table_profile_kept": " UNION ALL ".join(
        f"""SELECT {i} AS ordinal, '{c}' AS column_name, '{t}' AS data_type, count(*) AS row_count,
          count(*) - count({c}) AS null_count, CAST(min({c}) AS VARCHAR) AS min_value,
          CAST(max({c}) AS VARCHAR) AS max_value, true AS near_exact, true AS near_median FROM orders"""
        for i, (c, t) in enumerate(ORDER_TYPES, 1)
    ),
    "changed_customers": """
        SELECT c_custkey AS key, CASE WHEN c_custkey % 83 = 5 THEN 'added' ELSE 'changed' END AS change
        FROM customer WHERE c_custkey % 83 = 5 OR (c_custkey % 89 = 7 AND c_acctbal IS NOT NULL)
        UNION ALL SELECT c_custkey + 10000000, 'removed' FROM customer WHERE c_custkey % 97 = 3""",
    "table_fingerprint": f"""
        SELECT count(*) AS row_count, bit_xor(h) AS xor_hash, CAST(sum(CAST(h AS HUGEINT)) AS VARCHAR) AS sum_hash
        FROM (SELECT ('0x' || substr(md5({CUSTOMER_TEXT}), 1, 15))::BIGINT AS h FROM customer)""",
    "row_fingerprints": f"SELECT c_custkey, substr(md5({CUSTOMER_TEXT}), 1, 10) AS fingerprint FROM customer",
    "log_triage": """
        SELECT CASE
            WHEN regexp_matches(log, 'IllegalOptionException|customization-profiles')
              THEN 'invalid option / blocked profile'
            WHEN regexp_matches(log, 'another process has locked a portion of the file|ConfigurationAreaChecker')
              THEN 'workspace locked'
            WHEN contains(log, 'EXCEPTION_ACCESS_VIOLATION') THEN 'runtime crash'
            WHEN contains(log, 'DB Connection no longer available') THEN 'database lost'
            WHEN contains(log, 'created an empty data table') AND NOT wrote THEN 'no data for lot'
            WHEN broke THEN 'failed' WHEN NOT wrote THEN 'no output' ELSE 'ok' END AS run_class, count(*) AS runs
        FROM logs GROUP BY 1""",
    "csv_roundtrip": "SELECT * EXCLUDE (ordinal) FROM board",
    "json_roundtrip": f"SELECT {NAMES} FROM notes",
    "csv_roundtrip_in_lines": "SELECT * FROM board",
}
# Results that come another way must be the same.
FINAL["lot_monitor_refreshed"] = FINAL["lot_monitor"]
FINAL["lot_kpis_of_kept_monitor"] = FINAL["lot_kpis"]
FINAL["delayed_history_of_kept_monitor"] = FINAL["delayed_history"]


def _needed(sql: str) -> list[str]:
    """CTEs the text uses, directly or through others, in definition order."""
    import re

    words = set(re.findall(r"\w+", sql))
    found: set[str] = set()
    for name in reversed(CTES):
        if name in words:
            found.add(name)
            words |= set(re.findall(r"\w+", CTES[name]))
    return [n for n in CTES if n in found]


def oracle_sql() -> dict[str, str]:
    out = {}
    for key, final in FINAL.items():
        names = _needed(final)
        with_part = "WITH " + ",\n".join(f"{n} AS ({CTES[n]})" for n in names) if names else ""
        out[key] = f"{with_part}\n{final}"
    return out
