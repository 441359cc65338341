"""Fixed values that must equal the reference's for identical results.

Kept together, in their natural order, as plain text.  Nothing here is
derived; every other module reads these names.
"""

# --- fixed values: reorder policy state bins (left-closed bin edges) --------
INV_BINS = [0, 100, 300, 600, 1000, 2000]
DEMAND_BINS = [0, 100, 300, 600, 1000, 2000]
RISK_BINS = [0.0, 0.3, 0.6, 0.9]
DAY_BINS = [0, 1, 3, 7, 30]

# --- fixed values: actions, their reorder quantities ------------------------
ACTIONS = {
    0: "HOLD",
    1: "REORDER_SMALL",
    2: "REORDER_MEDIUM",
    3: "REORDER_LARGE",
    4: "EMERGENCY_REORDER",
    5: "SWITCH_SUPPLIER",
}
REORDER_QTY = {0: 0, 1: 150, 2: 400, 3: 800, 4: 600, 5: 0}

# --- fixed values: reward rules ---------------------------------------------
HOLDING_COST_PER_UNIT = 0.05
STOCKOUT_PENALTY = -50.0
FULFILMENT_PER_UNIT = 0.5
OVERCAPACITY_LIMIT = 1000
OVERCAPACITY_PENALTY = -20.0
EMERGENCY_ACTION_COST = -15.0
STANDARD_ACTION_COST = -2.0
ANOMALY_MITIGATION = 10.0
GAMMA = 0.95

# --- fixed values: shipping mode ordinal, risk label score -----------------
SHIPPING_MODE_ENC = {"Standard Class": 0, "Second Class": 1, "First Class": 2, "Same Day": 3}
RISK_LABELS = ["LOW", "MEDIUM", "HIGH"]
RISK_SCORE = {"LOW": 0.2, "MEDIUM": 0.55, "HIGH": 0.85}
RISK_SCORE_UNKNOWN = 0.5
EMERGENCY_RISK_SCORE = 0.8

# --- fixed values: demand feature columns (model input order) --------------
DEMAND_FEATURES = [
    "day_of_week", "month", "quarter", "day_of_year", "is_weekend",
    "rolling_7d_mean", "rolling_30d_mean", "rolling_7d_std",
    "lag_1", "lag_7", "lag_14", "lag_30",
]
DEMAND_LAGS = [1, 7, 14, 30]

# --- fixed values: delay-risk feature columns (model input order) ----------
RISK_FEATURES = [
    "shipping_mode_enc", "discount_rate", "order_value", "supplier_delay_rate",
    "market_enc", "region_enc", "category_enc", "segment_enc", "type_enc",
    "ocountry_enc", "order_month", "order_dow", "quantity",
]
# label-coded source column for each encoded feature
RISK_CODED = {
    "market_enc": "market",
    "region_enc": "order_region",
    "category_enc": "category",
    "segment_enc": "customer_segment",
    "type_enc": "order_type",
    "ocountry_enc": "country",
}

# --- fixed values: supplier scorecard --------------------------------------
SUPPLIER_FEATURES = ["avg_delivery_time", "price_deviation", "fulfillment_rate", "complaint_freq"]
PRICE_DEVIATION_EPS = 1e-9
IFOREST_TREES = 300
IFOREST_CONTAMINATION = 0.03
IFOREST_MAX_SAMPLES = 256

# --- fixed values: request defaults ----------------------------------------
REQUEST_DEFAULTS = {
    "inventory": 120.0,
    "days_to_delivery": 5.0,
    "start_node": 0,
    "goal_node": 6,
    "order_quantity": 1.0,
    "order_value": 500.0,
    "discount_rate": 0.1,
    "supplier_delay_rate": 0.2,
    "avg_delivery_time": 5.0,
    "price_deviation": 0.1,
    "fulfillment_rate": 0.85,
    "complaint_freq": 10.0,
    "avg_order_value_per_unit": 100.0,
}

# --- fixed values: per-order demand multiplier ------------------------------
VALUE_SCALE_MIN = 0.5
VALUE_SCALE_MAX = 1.8
URGENCY_DAYS = 3.0
URGENCY_STEP = 0.12
QUANTITY_SCALE_DIVISOR = 400.0
QUANTITY_SCALE_MAX = 8.0

# --- fixed values: lane weights --------------------------------------------
EARTH_RADIUS_KM = 6371.0
FUEL_COST_PER_KM = 0.08
TIME_COST_FACTOR = 0.5
AIR_COST_MULTIPLIER = 10.0

# --- texts: each names the step that really decided --------------------------
ROUTE_TYPE_EMERGENCY = "EMERGENCY"
ROUTE_TYPE_STANDARD = "STANDARD"
TRIGGER_RL = "Reorder policy: EMERGENCY_REORDER"
TRIGGER_ANOMALY = "Supplier statistics: department flagged as unusual"
TRIGGER_RISK = "Delay risk: score %s > 0.8"
TRIGGER_NORMAL = "None: least-cost route"

# --- fixed values: texts ----------------------------------------------------
NO_PATH_ERROR = "No path found"
HISTORY_LIMIT = 50
CHAT_HISTORY_TURNS = 6
