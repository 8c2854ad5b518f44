"""Column functions: integers, masks, storage estimates."""
