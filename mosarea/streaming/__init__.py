"""The monthly direct estimate over a stream of interviews."""
