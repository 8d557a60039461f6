"""Training-data operators: filtering, de-duplication, tokenising, sharding and archives."""
