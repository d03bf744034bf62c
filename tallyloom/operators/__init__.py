"""The operators: functions from DataFrame to DataFrame."""
