"""Plans that are compiled on the driver: paths and schemas."""
