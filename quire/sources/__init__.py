"""Reading books, notes and logs, and writing what comes of them."""
