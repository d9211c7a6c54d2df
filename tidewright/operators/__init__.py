"""Sensor operators over long signals: (sensor, row_idx, time, value), one row for each sample."""
