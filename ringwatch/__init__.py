"""Ring-level risk analytics for tunnel-boring-machine sensor data on Spark."""
