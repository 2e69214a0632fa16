"""Column layout of the lot-tracking tables: fixed values, as the tables come with them."""

from __future__ import annotations

TRANSACTIONS = """
    lot string, facility string, route string, operation string, to_operation string,
    time_stamp timestamp_ntz, date_stamp timestamp_ntz, deleted_flag string, transcode string,
    qty_out_1 int, unit_1 string, equipment string, work_center string, cost_center string,
    rework_flag string, hot_lot_flag string, hot_oper_flag string, super_hot_flag string,
    enter_operation_time_stamp timestamp_ntz, movein_time_stamp timestamp_ntz,
    due_cycle_time double, due_process_cycle_time double, sps_number string, main_sps string
"""

ROUTE_OPERATIONS = """
    facility string, route string, operation string, operation_sequence_number int,
    create_date timestamp_ntz, process_cycle_time double, queue_cycle_time double,
    optional_oper_flag string
"""

OPERATIONS = """
    facility string, operation string, operation_long_desc string,
    operation_short_desc string, store_flag_rep string
"""

EQUIPMENT = "equipment string, equipment_desc string"

PARAMETERS = "var_name string, var_value string"

HISTORY_MES = """
    lot_number string, operation string, transaction string, trans_timestamp timestamp_ntz,
    current_sip string, actual_entity string, operator_id string, commenttext string,
    is_reserved string, is_reserved_machine string, is_reserved_operator string,
    quantity_1 string, hold_code string, hold_comment string
"""

HISTORY_FALLBACK = """
    lot string, operation string, transcode string, time_stamp timestamp_ntz,
    sps_number string, equipment string, operator string, transaction_comment string
"""

# Payload key and board column of each order attribute.
ORDER_COLUMNS = {
    "febesOrderId": "External Order",
    "owner": "Owner",
    "orderStatus": "Order Status",
    "orderQuantity": "Start Quan.",
    "orderUnit": "Order Unit",
    "orderRemark": "Order Rem.",
    "waferSize": "Wafer Size",
    "lotNumber": "Lot Number",
    "lotResponsible": "Lot Responsible",
    "deltaCurrentToPlan": "Delta Current To Plan",
    "requestor": "Requestor",
    "lotPurpose": "Lot Purpose",
    "priority": "Priority",
    "priorityCorridor": "Priority Corridor",
    "currentFacility": "Current Facility",
    "currentOperation": "Current Op.",
    "confirmedDeliveryDate": "Confirmed Delivery",
    "currentDeliveryDate": "Current Delivery",
    "businessDivision": "Division",
    "processGroup": "Process Group",
    "createUser": "Create User",
}
# Every value is kept as it came; what looks like a number is read as one where it is shown.
ORDER_ELEMENT = ", ".join(f"{k} string" for k in ORDER_COLUMNS)

# Columns of the annotation table.
ANNOTATION_COLUMNS = ["LOT NUMBER", "OPERATION", "DESCRIPTION", "ISSUE", "REMARKS"]
