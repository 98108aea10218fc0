"""Reading dialogues, writing memories, and stores of them."""
