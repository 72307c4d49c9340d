"""Constants and schemas of the equation evaluator and the two launch-control machines."""

from pyspark.sql import types as T

# Operators, states and inputs of the behaviour that is rebuilt here.
OPERATORS = ("+", "-", "*", "/", "%", "//")
FIVE_STATES = ("IDLE", "CIRCUIT_TESTED", "ENABLED", "READY", "LAUNCHED")
# Fixed value: the declared adjacency of the five states.
FIVE_DECLARED = {"IDLE": ("CIRCUIT_TESTED",), "CIRCUIT_TESTED": ("ENABLED", "IDLE"), "ENABLED": ("READY", "IDLE"), "READY": ("LAUNCHED", "IDLE"), "LAUNCHED": ("IDLE",)}
FIVE_BUTTONS = ("test", "enable", "ready", "launch", "lpu_cancel", "cu_cancel")
SEVEN_STATES = ("IDLE", "TESTING", "TEST_PASS", "ENABLED", "READY", "LAUNCHING", "LAUNCHED")
SEVEN_INPUTS = ("igniter", "test", "enable", "ready", "launch", "lp_cancel", "cu_cancel", "circuit", "full_reset")
DELAYS_FIVE_MS = {"test": 600, "ready": 400, "launch": 500}
DELAYS_SEVEN_MS = {"test": 1400, "launch": 2200}

BUTTON_EVENTS = T.StructType([T.StructField("device_id", T.LongType()), T.StructField("ts", T.TimestampType()), T.StructField("seq", T.LongType()), T.StructField("button", T.StringType())])
