"""tabloom.functions"""
